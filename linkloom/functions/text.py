"""Text, date and hashing functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Content types of feeds.
FEED_TYPES = ("application/rss+xml", "application/rdf+xml", "application/atom+xml", "application/xml", "text/xml")
#: First epoch second of the year 10000: larger numbers are milliseconds.
YEAR_10000 = 253402300800


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def date_part(published: Column, part: str) -> Column:
    """A part of an ISO 8601 text as int: '' gives 0, null gives null; 'date' is the text itself."""
    if part == "date":
        return published
    start, length = {"year": (1, 4), "month": (6, 2), "day": (9, 2), "hour": (12, 2), "minute": (15, 2), "second": (18, 2)}[part]
    digits = F.regexp_extract(F.substring(published, start, length), "^ *([0-9]+)", 1)
    return F.when(published.isNull(), None).when(digits == "", 0).otherwise(digits.try_cast("int")).cast("int")


def epoch_time(x: Column) -> Column:
    """Seconds since 1970, or milliseconds where seconds would lie beyond the year 9999."""
    return F.when(F.abs(x) < YEAR_10000, F.timestamp_seconds(x)).otherwise(F.timestamp_millis(x.cast("long")))


def iso_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx")


def lower_set(c: Column) -> Column:
    return F.array_distinct(F.transform(c, lambda x: F.lower(x)))


def path_safe(c: Column) -> Column:
    """Punctuation and spaces but - _ / . become -, as do characters outside Latin-1."""
    return F.regexp_replace(c, r"[!\"#$%&'()*+,:;<=>?@\[\\\]^`{|}~ ]|[^\x{0}-\x{FF}]", "-")


def percent_quote(c: Column) -> Column:
    """UTF-8 bytes other than letters, digits and _.-~/ as %XX."""
    plain = F.url_encode(c)  # application/x-www-form-urlencoded, repaired
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return plain


def percent_unquote(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


ESCAPES = {
    None: lambda c: c,
    "none": lambda c: c,
    "percent": percent_quote,
    "replace": path_safe,
    "unquote": percent_unquote,
    "unquote-replace": lambda c: path_safe(percent_unquote(c)),
}


def is_feed_type(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.when(content_type.isNull(), True).otherwise(kind.isin(*FEED_TYPES))


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long"))


def sha1_hex(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def random_hex(digits: int) -> Column:
    """Another text of hexadecimal digits for each row."""
    parts = [F.replace(F.uuid(), F.lit("-"), F.lit("")) for _ in range(-(-digits // 32))]
    return F.substring(F.concat(*parts), 1, digits)


def falsy(c: Column, values: tuple = ("", "0", "false", "no", "none")) -> Column:
    return c.isNull() | F.lower(c).isin(*values)


def keyword_score(weights: dict[float, list[str]], target: Column, phrases: Column) -> Column:
    """Sum of the weights whose words (regular expressions, any case) are in the target, and as whole words in the
    phrases; a weight of minus infinity that matches gives minus infinity."""
    out = F.lit(0.0)
    for weight, words in weights.items():
        any_word = "|".join(words)
        for c, pattern in ((target, f"(?i)(?:{any_word})"), (phrases, f"(?i)\\b(?:{any_word})\\b")):
            out = out + F.when(F.coalesce(c.rlike(pattern), F.lit(False)), F.lit(float(weight))).otherwise(F.lit(0.0))
    return out
