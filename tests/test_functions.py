from urllib.parse import quote, unquote, urlsplit

import pytest
from pyspark.sql import functions as F

from linkloom.functions import templates, text as fn, urls as fu
from linkloom.functions.html import links
from linkloom.plans.filters import domain_filter, predicate, where

URLS = [
    "https://xkcd.com/937/", "https://imgs.xkcd.com/comics/tornadoguard.png", "HTTP://User:p@Host:80/a/b?x=1&y=2#f", "//cdn.example.com/x.js", "/relative?q", "mailto:a@b.c", "", "http://h", "?only", "#frag", "a:b:c",
]


def values(spark, column, rows, name="u", kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} {kind}")
    return [r[0] for r in df.withColumn("_out", column).orderBy("i").select("_out").collect()]


@pytest.mark.parametrize("part", ["scheme", "netloc", "path", "query", "fragment"])
def test_url_parts_are_those_of_the_standard_library(spark, part):
    assert values(spark, fu.url_part(F.col("u"), part), [*URLS, None]) == [*[getattr(urlsplit(u), part) for u in URLS], None]


def test_url_kinds(spark):
    u = F.col("u")
    assert values(spark, fu.is_http(u), URLS[:7]) == [True, True, True, True, False, False, False]
    assert values(spark, fu.ensure_protocol(u), URLS[3:4]) == ["http://cdn.example.com/x.js"]
    assert values(spark, fu.network_path(u), URLS[2:3]) == ["//User:p@Host:80/a/b?x=1&y=2"]
    assert values(spark, fu.domain_parents(u), ["a.b.c", "com", None]) == [["a.b.c", "b.c"], [], []]
    assert values(spark, fu.feed_uri(u), ["feed/http://a/b"]) == ["http://a/b"]
    assert values(spark, fu.image_rewrite(u), ["http://m/a_500.jpg"]) == ["https://m/a_1280.jpg"]
    assert values(spark, fu.under(u, "b.c"), ["b.c", "a.b.c", "ab.c", None]) == [True, True, False, None]
    assert values(spark, fu.host_under(u, ["XKCD.com"]), URLS[:4]) == [True, True, False, False]


def test_dates(spark):
    p = F.col("u")
    rows = ["2011-08-12T04:05:04+00:00", "", None, "2011"]
    assert values(spark, fn.date_part(p, "year"), rows) == [2011, 0, None, 2011]
    assert values(spark, fn.date_part(p, "month"), rows) == [8, 0, None, 0]
    assert values(spark, fn.date_part(p, "second"), rows) == [4, 0, None, 0]
    assert [str(v) for v in values(spark, fn.epoch_time(p), [1313121904, 1313121904000], kind="long")] == ["2011-08-12 04:05:04"] * 2


def test_escapes(spark):
    rows = ["a b/c?d=é~x*+", "100%", "日本.txt", "a%20b%zz", "-_/.", "[x]\\^`{|}"]
    assert values(spark, fn.percent_quote(F.col("u")), rows) == [quote(r) for r in rows]
    assert values(spark, fn.percent_unquote(F.col("u")), ["a%20b+c", "plain"]) == [unquote("a%20b+c"), "plain"]
    safe = "".join
    want = [safe("-" if c in "!\"#$%&'()*+,:;<=>?@[\\]^`{|}~ " or ord(c) > 255 else c for c in r) for r in rows]
    assert values(spark, fn.path_safe(F.col("u")), rows) == want


def test_templates(spark):
    df = spark.createDataFrame([("xkcd.com", 2011, 8, None, True, 1.5)], "n string, y int, m int, z string, b boolean, f double")
    columns = {c: F.col(c) for c in df.columns}
    types = {"b": "boolean"}
    row = {"n": "xkcd.com", "y": 2011, "m": 8, "z": None, "b": 1, "f": 1.5}
    for t in ("%(n)s/%(y)d%(m)02d.txt", "%(n).4s|%(n)10s|%(n)-10s|", "100%% %(z)s", "%(b)s", "%(f).3f", "%(m)i", "plain"):
        assert df.select(templates.render(t, columns, types)).first()[0] == t % row
    with pytest.raises(KeyError):
        templates.render("%(nope)s", columns)
    with pytest.raises(ValueError):
        templates.render("50% off", columns)
    path = lambda t: df.select(templates.file_path(t, columns)).first()[0]
    assert path("%(n)s/a.txt") == "xkcd.com/a.txt"
    assert path("../%(n)s") == "-../xkcd.com"
    assert path(".") == "-." and path("..") == "-.."


def test_url_variants(spark):
    trees = {r"https?://(?P<user>\w+)\.blog\.net/(\d+)?": ["http://%(user)s.blog.net/rss/%(2)s"], r".*": ["%(scheme)s:%(network_path)s"]}
    got = values(spark, templates.url_variants(F.col("u"), trees), ["http://joe.blog.net/12", "https://a.b/c?d", None])
    assert got == [["http://joe.blog.net/rss/12"], ["https://a.b/c?d"], None]


def test_html_links(spark):
    page = '<a href="http://a.b/c"><img src="//i.j/k.png" data-src="http://a.b/c"/></a><a href="/rel">x</a><a href="mailto:x@y">m</a><p data-href="HTTPS://u.v/w?a=1&amp;b=2"><script>"<a href=\'http://no.no\'>"</script><broken'
    df = spark.createDataFrame([(page, "http://base.net/d/e"), (None, None), ("", "http://x")], "h string, b string")
    got = [[(l["url"], l["tag"]) for l in r[0]] for r in df.select(links(F.col("h"))).collect()]
    assert got[0] == [("http://a.b/c", "a"), ("http://i.j/k.png", "img"), ("http://a.b/c", "img"), ("HTTPS://u.v/w?a=1&b=2", "p")] and got[1:] == [[], []]
    assert ("http://base.net/rel", "a") in [(l["url"], l["tag"]) for l in df.select(links(F.col("h"), F.col("b"))).first()[0]]


def test_predicates(spark):
    c = F.col("u")
    rows = ["Abc", "abd", "x_y", "É", None, "a\\b"]
    check = lambda op, v, mode="like": values(spark, predicate(c, "string", op, v, mode), rows)
    assert check("startswith", "AB") == [True, True, False, False, None, False]
    assert check("startswith", "AB", "exact") == [False, False, False, False, None, False]
    assert check("contains", "_b") == [True, True, False, False, None, True]
    assert check("in", "é") == [False, False, False, False, None, False]
    assert check("endswith", "\\b") == [False, False, False, False, None, True]
    assert check("is", "None") == [False, False, False, False, True, False]
    assert check("==", "None") == [False, False, False, False, None, False]
    assert check("gt", "abc") == [False, True, True, True, None, False]
    numbers = lambda op, v: values(spark, predicate(c, "int", op, v), [1, 20, None], kind="int")
    assert numbers("is", "20") == [False, True, None] and numbers("is", "x") == [False, False, None]
    assert numbers("lt", "3") == [True, False, None] and numbers("startswith", "2") == [False, True, None]
    with pytest.raises(ValueError):
        numbers("lt", "abc")
    with pytest.raises(ValueError):
        check("like", "a")
    flags = lambda op, v: values(spark, predicate(c, "boolean", op, v), [True, False, None], kind="boolean")
    assert flags("is", "True") == [True, False, None] and flags("is", "False") == [False, True, None] and flags("is", "None") == [False, False, True]


def test_where_is_three_valued(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "u string")
    columns, types = {"u": F.col("u")}, {"u": "string"}
    kept = lambda i, e: df.where(where(i, e, columns, types)).count()
    assert kept([], []) == 3 and kept([("u", "is", "a")], []) == 1 and kept([], [("u", "is", "a")]) == 1
    with pytest.raises(KeyError, match="known are u"):
        kept([("v", "is", "a")], [])


def test_domain_filters_are_ored(spark):
    rows = ["http://a.x.com", "http://Y.org:80", "http://z.net"]
    filters = [("domain", "under", "x.com"), ("domain", "under", "y.org:80"), ("path", "is", "q")]
    assert values(spark, domain_filter(F.col("u"), filters), rows) == [True, True, False]
    assert values(spark, domain_filter(F.col("u"), filters, exclude=True), rows) == [False, False, True]
    assert values(spark, domain_filter(F.col("u"), [("path", "is", "q")]), rows) == [False] * 3


def test_small_functions(spark):
    assert values(spark, fn.is_feed_type(F.col("u")), [None, "text/xml; charset=x", "text/html"]) == [True, True, False]
    assert values(spark, fn.duration(F.col("u")), [3661], kind="long") == ["1h 1m 1s"]
    score = fn.keyword_score({2.0: ["cat"], 1.0: ["dog", "d.g"]}, F.col("u"), F.lit("a Dog, catalog"))
    assert values(spark, score, ["concat", "x"]) == [3.0, 1.0]


def test_presets(spark):
    from linkloom import presets

    got = values(spark, presets.feed_candidates(F.col("u")), ["http://joe-deactivated12.tumblr.com/post/1", "https://x.livejournal.com/", "http://none.org/"])
    assert got[0][0] == "http://joe.tumblr.com/rss" and len(got[0]) == 8
    assert got[1] == ["http://x.livejournal.com/data/rss", "https://x.livejournal.com/data/rss", "http://x.livejournal.com/data/atom", "https://x.livejournal.com/data/atom"] and got[2] is None
    assert presets.for_feed("http://a.wordpress.com/feed/") is presets.PRESETS["wordpress"] and presets.for_feed("http://a.b/") is None


def test_api_url(spark):
    got = values(spark, fu.api_url("https://api.example.com/v3/streams/", F.col("u"), count=10, q="a b&c"), ["feed/http://x.y/z"])
    assert got == ["https://api.example.com/v3/streams/feed%2Fhttp%3A%2F%2Fx.y%2Fz?count=10&q=a%20b%26c"]
