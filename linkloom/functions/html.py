"""Hyperlinks of HTML: an Arrow-batched parser, as no native expression reads tag soup."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F

ATTRIBUTES = ("src", "href", "data-src", "data-href")


class _Links(HTMLParser):
    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.found = base, {}

    def handle_starttag(self, tag, attrs):
        for name, value in attrs:
            if name in ATTRIBUTES and value:
                self._add(value.strip(), tag)

    handle_startendtag = handle_starttag

    def _add(self, value: str, tag: str) -> None:
        try:
            parts = urlsplit(value)
            if not parts.scheme and parts.netloc:
                value = f"http:{value}"
            elif parts.scheme.lower() not in ("http", "https") or not parts.netloc:
                if self.base is None or parts.scheme:
                    return
                value = urljoin(self.base, value)
        except ValueError:
            return
        self.found.setdefault((value, tag), None)


def _extract(markup: str | None, base: str | None) -> list[dict]:
    if not markup:
        return []
    parser = _Links(base)
    try:
        parser.feed(markup)
        parser.close()
    except (AssertionError, ValueError):
        pass  # what was found before a part that can't be parsed stays
    return [{"url": u, "tag": t} for u, t in parser.found]


def links(markup: Column, base: Column | None = None) -> Column:
    """array<struct<url, tag>>: absolute http(s) and protocol-relative URLs of src, href, data-src, data-href of all
    elements, distinct. Relative URLs are dropped, or with ``base`` resolved."""

    if base is None:

        @F.pandas_udf("array<struct<url:string,tag:string>>")
        def found(m: pd.Series) -> pd.Series:
            return m.map(lambda x: _extract(x, None))

        return found(markup)

    @F.pandas_udf("array<struct<url:string,tag:string>>")
    def resolved(m: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_extract(x, y) for x, y in zip(m, b)])

    return resolved(markup, base)
