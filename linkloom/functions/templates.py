"""%-templates over columns: file names and URL variants."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, functions as F

from .urls import network_path, path_query, url_part

_FIELD = re.compile(r"%(?:\((?P<key>[^)]*)\)(?P<flags>[-0+ #]*)(?P<width>\d*)(?:\.(?P<precision>\d+))?(?P<kind>[sdiufxXr])|(?P<percent>%))")


def template_keys(template: str) -> list[str]:
    return list(dict.fromkeys(m["key"] for m in _FIELD.finditer(template) if m["key"] is not None))


def render(template: str, columns: Mapping[str, Column], types: Mapping[str, str] | None = None) -> Column:
    """Python's %(key)spec formatting as one expression. Null prints None, booleans print 1 and 0."""
    types, pattern, values, done = types or {}, "", [], 0
    for m in _FIELD.finditer(template):
        literal = template[done : m.start()]
        if "%" in literal:
            raise ValueError(f"a lone % in {template!r}")
        pattern, done = pattern + literal, m.end()
        if m["percent"]:
            pattern += "%%"
            continue
        if m["key"] not in columns:
            raise KeyError(f"{m['key']!r} is unknown; known are {', '.join(columns)}")
        column, kind = columns[m["key"]], m["kind"]
        if types.get(m["key"]) == "boolean":
            column = column.cast("int")
        if kind in "diu":
            text = F.format_string("%" + m["flags"] + m["width"] + "d", column.cast("long"))
            values.append(F.when(column.isNull(), "None").otherwise(text))
            pattern += "%s"
        elif kind in "fxX":
            text = F.format_string("%" + m["flags"] + m["width"] + (f".{m['precision']}" if m["precision"] else "") + kind, column.cast("double" if kind == "f" else "long"))
            values.append(F.when(column.isNull(), "None").otherwise(text))
            pattern += "%s"
        else:
            values.append(F.coalesce(column.cast("string"), F.lit("None")))
            pattern += "%" + "".join(f for f in m["flags"] if f == "-" and m["width"]) + m["width"] + (f".{m['precision']}" if m["precision"] else "") + "s"
    literal = template[done:]
    if "%" in literal:
        raise ValueError(f"a lone % in {template!r}")
    return F.format_string(pattern + literal, *values)


def file_path(template: str, columns: Mapping[str, Column], escape=lambda c: c, types: Mapping[str, str] | None = None) -> Column:
    """The file that a row goes to: a name that ends in / gets index and the template's extension; . and .. are
    made harmless, as are such parts within a path."""
    name = template.rsplit("/", 1)[-1]
    extension = name[name.index(".", 1) :] if "." in name[1:] else ""
    path = escape(render(template, columns, types))
    path = F.when(path.endswith("/"), F.concat(path, F.lit(f"index{extension}"))).otherwise(path)
    path = F.when(path.isin(".", ".."), F.concat(F.lit("-"), path)).otherwise(path)
    path = F.regexp_replace(path, r"(^|/)(\.\.)(?=/)", "$1-..")
    return F.when(path == "", F.lit("-")).otherwise(F.regexp_replace(path, "^/+", ""))


#: Templates, or a function of the fields' columns that gives an array of URLs.
Templates = list[str] | Callable[[Mapping[str, Column]], Column]


def url_variants(url: Column, trees: Mapping[str, Templates]) -> Column:
    """The URLs built by the templates of the first pattern that matches at the start, as an array; none: null.

    Templates, and functions in place of them, have the fields scheme, netloc, path, query, fragment, network_path, path_query, original, and the
    pattern's groups by number and by name.
    """
    out = F.lit(None).cast("array<string>")
    for pattern, templates in reversed(list(trees.items())):
        compiled = re.compile(pattern)
        java = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
        anchored = java if java.startswith("^") else f"^(?:{java})"
        parts = {p: url_part(url, p) for p in ("scheme", "netloc", "path", "query", "fragment")}
        parts |= {"network_path": network_path(url), "path_query": path_query(url), "original": url}
        groups = {str(i): F.regexp_extract(url, anchored, i) for i in range(1, compiled.groups + 1)}
        groups |= {name: F.regexp_extract(url, anchored, i) for name, i in compiled.groupindex.items()}
        fields = {**parts, **groups}
        built = templates(fields) if callable(templates) else F.array(*[render(t, fields) for t in templates])
        out = F.when(url.rlike(anchored), built).otherwise(out)
    return out
