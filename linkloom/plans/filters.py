"""The filter grammar: (attribute, predicate, value) triples become columns.

All includes and excludes are ANDed; an exclude is NOT. Logic is three-valued, so a row whose attribute is null is
dropped by an include and by an exclude alike. startswith, endswith and contains fold the case of A-Z only, and % and _ in the
value are wildcards, as in the LIKE that the grammar comes from.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from ..functions.text import ascii_lower
from ..functions.urls import host_under, under

Filter = tuple[str, str, str]
ALIASES = {"==": "is", "in": "contains", ">": "gt", "<": "lt", ">=": "ge", "<=": "le"}
PREDICATES = ("is", "under", "startswith", "endswith", "contains", "gt", "ge", "lt", "le")


def _like(c: Column, pattern: str) -> Column:
    folded = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in pattern)
    return ascii_lower(c).like(folded.replace("\\", "\\\\"))


def _text(c: Column, kind: str) -> Column:
    return c.cast("int").cast("string") if kind == "boolean" else c.cast("string")


def predicate(c: Column, kind: str, op: str, value: str, mode: str = "like") -> Column:
    """One predicate on a column of type ``kind`` (string, int or boolean). mode 'exact' takes the texts of
    startswith, endswith and contains literally and with case."""
    spelled, op, value = op, ALIASES.get(op, op), str(value)
    if op not in PREDICATES:
        raise ValueError(f"unknown predicate {spelled!r}; known are {', '.join((*PREDICATES, *ALIASES))}")
    if spelled == "is" and value == "None":
        return c.isNull()
    if spelled == "is" and value in ("True", "False"):
        truth = value == "True"
        return c == F.lit(truth) if kind == "boolean" else (c == F.lit(int(truth)) if kind == "int" else c == F.lit(str(int(truth))))
    if op == "under":
        return under(_text(c, kind), value)
    if op in ("startswith", "endswith", "contains"):
        text = _text(c, kind)
        if mode == "exact":
            return {"startswith": text.startswith, "endswith": text.endswith, "contains": text.contains}[op](value)
        return _like(text, {"startswith": f"{value}%", "endswith": f"%{value}", "contains": f"%{value}%"}[op])
    if kind in ("int", "boolean"):
        number = int(value) if re.fullmatch(r"\s*[+-]?\d+\s*", value) else None
        if number is None and op == "is":  # a text never equals a number
            return F.when(c.isNotNull(), F.lit(False))
        if number is None:
            raise ValueError(f"{op} needs a number here, not {value!r}")
        left, right = c.cast("long"), F.lit(number)
    else:
        left, right = c, F.lit(value)
    return {"is": left == right, "gt": left > right, "ge": left >= right, "lt": left < right, "le": left <= right}[op]


def where(includes: Sequence[Filter], excludes: Sequence[Filter], columns: Mapping[str, Column], types: Mapping[str, str], mode: str = "like") -> Column:
    """The conjunction of all filters; true without any. An unknown attribute is an error that names the known."""
    out = F.lit(True)
    for negate, filters in ((False, includes), (True, excludes)):
        for attribute, op, value in filters or ():
            if attribute not in columns:
                raise KeyError(f"unknown attribute {attribute!r}; known are {', '.join(columns)}")
            p = predicate(columns[attribute], types.get(attribute, "string"), op, value, mode)
            out = out & (~p if negate else p)
    return out


def domain_filter(url: Column, filters: Sequence[Filter], exclude: bool = False) -> Column:
    """Only ``domain under X`` counts, others are ignored; several X are ORed. Without filters: true."""
    if not filters:
        return F.lit(True)
    within = host_under(url, [v for k, op, v in filters if k == "domain" and op == "under"])
    return ~within if exclude else within
