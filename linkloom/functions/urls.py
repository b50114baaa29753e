"""URL functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: RFC 3986, appendix B; groups: scheme, netloc, path, query, fragment.
URL = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"
PARTS = ("scheme", "netloc", "path", "query", "fragment")


def url_part(url: Column, part: str) -> Column:
    """A part of a URL, '' where absent; null for a null URL."""
    out = F.regexp_extract(url, URL, PARTS.index(part) + 1)
    return F.lower(out) if part == "scheme" else out


def is_http(url: Column) -> Column:
    """Scheme http or https, or none but a host."""
    scheme = url_part(url, "scheme")
    return scheme.isin("http", "https") | ((scheme == "") & (url_part(url, "netloc") != ""))


def is_absolute_http(url: Column) -> Column:
    return is_http(url) & (url_part(url, "netloc") != "")


def ensure_protocol(url: Column, scheme: str = "http") -> Column:
    return F.when(url_part(url, "scheme") == "", F.concat(F.lit(f"{scheme}:"), url)).otherwise(url)


def domain_parents(domain: Column) -> Column:
    """All suffixes of at least two labels, the domain itself first."""
    labels = F.split(domain, "[.]")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))


def path_query(url: Column) -> Column:
    query = url_part(url, "query")
    return F.concat(url_part(url, "path"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def network_path(url: Column) -> Column:
    """//host/path?query"""
    return F.concat(F.lit("//"), url_part(url, "netloc"), path_query(url))


def under(domain: Column, parent: str) -> Column:
    """The domain itself or one below it; case-sensitive."""
    return (domain == parent) | domain.endswith(f".{parent}")


def host_under(url: Column, domains: list[str]) -> Column:
    """Whether a URL's host is one of the domains or below one, in any case; no domains: false."""
    host = F.lower(url_part(url, "netloc"))
    out = F.lit(False)
    for d in domains:
        out = out | (host == d.lower()) | host.endswith(f".{d.lower()}")
    return out


def site(url: Column) -> Column:
    return F.concat(url_part(url, "scheme"), F.lit("://"), url_part(url, "netloc"))


def feed_uri(feed_id: Column) -> Column:
    """feed/http://... -> http://..."""
    return F.regexp_replace(feed_id, "^[^/]*/", "")


def feed_id(uri: Column) -> Column:
    return F.concat(F.lit("feed/"), uri)


def api_url(base: str, argument: Column, **params: Column | str | int) -> Column:
    """base + argument?key=value&..., all percent-encoded, in the order given."""
    encode = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    pairs = [F.concat(encode(F.lit(k)), F.lit("="), encode(v if isinstance(v, Column) else F.lit(str(v)))) for k, v in params.items()]
    query = F.concat(F.lit("?"), F.concat_ws("&", *pairs)) if pairs else F.lit("")
    return F.concat(F.lit(base), encode(argument), query)


def image_rewrite(url: Column) -> Column:
    """The largest variant of an image that is kept by width, over https."""
    return F.regexp_replace(F.regexp_replace(url, "_[0-9]+[.](jpg|png|gif)", "_1280.$1"), "^http:", "https:")


def image_path(url: Column) -> Column:
    return F.concat(url_part(url, "netloc"), url_part(url, "path"))


def ignored_site(domain: Column, ignored: list[str], suffix: str = "media.tumblr.com") -> Column:
    return domain.isin(ignored) | domain.endswith(suffix) if ignored else domain.endswith(suffix)
