"""URL expressions against the standard library."""

import random
import re
from urllib.parse import quote, unquote, urljoin, urlparse, urlsplit, urlunparse, urlunsplit

import pytest
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.functions.dom import page_hrefs
from pagemill.functions.urls import url_matches_any
from pagemill.operators.links import CLICK_HREFS, link_targets, page_targets
from pagemill.operators.patterns import filter_patterns, pattern_table, required_text
from pagemill.storage import Workspace

BASES = ["http://A.com/b/c/d;p?q", "https://shop.example.com", "https://Shop.example.com/a/b/", "http://x.org/a//b/../c.html?x=1#f",
         "/just/path", "", "mailto:a@b", "http://h/;x/y;z", "http://u:p@H.org:80/x/./y", "file:///etc/x", "http://h//a//b"]
HREFS = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", ".", "./", "..", "../", "../g",
         "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "..g", "./../g", "./g/.", "g/./h", "g/../h",
         "g;x=1/./y", "g;x=1/../y", "http:g", "HTTPS://SHOP.example.com/C/1", "mailto:x@Y.com", "javascript:void(0)", "/für/ü b",
         " /sp ", "\t/tab\nx", "a:b", "?", "#", "/a//b", "a//b", "//", "///x", "http://", "HTTP://H?x", "/..;x", "..;x", ";", ";/x",
         "data:,x#y", "1:2", "x y?z=%20#f g", "/.", "/..", "/a/.", "tel:1;2", "ws://S/x", "%zz%41", "/a%2fb+c", " ", "x/..", "/x?q#", "/x\n", "g\n", "http://h/x\n", "HTTP://Q.r/s//t", "../g/h/", "../../../../z", "https://Q", "g//h", "a./b", ".a/b"]


def normal(url):
    p = urlsplit(url)
    return urlunsplit([p.scheme.lower(), p.netloc.lower(), p.path, p.query, p.fragment])


def rule_form(url):
    p = urlparse(unquote(url))
    return quote(urlunparse(("", "", p.path, p.params, p.query, p.fragment))) or "/"


def test_against_the_standard_library(spark):
    rows = [(b, h) for b in BASES for h in [*HREFS, "", None]]
    h = F.col("h")
    got = spark.createDataFrame(rows, "b string, h string").select(
        "b", "h", U.resolve_link(F.col("b"), h).alias("link"), U.normalize_url(h).alias("norm"), U.url_domain(h).alias("domain"),
        U.robots_path(h).alias("path")).collect()
    for r in got:
        if not r.h:
            assert r.link == ""
            continue
        assert r.link == normal(urljoin(r.b, r.h)), (r.b, r.h)
        assert r.norm == normal(r.h)
        assert r.domain == urlparse(r.h).netloc
        assert r.path == rule_form(r.h)


def test_normalising_twice_changes_nothing(spark):
    df = spark.createDataFrame([(h,) for h in HREFS], "h string").withColumn("n", U.normalize_url(F.col("h")))
    assert df.filter(U.normalize_url(F.col("n")) != F.col("n")).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([("https://a.b.com/x",), ("https://b.com/y.html",), ("/rel",)], "u string")
    u = F.col("u")
    assert [r[0] for r in df.filter(U.url_in_domains(u, ["b.com"])).collect()] == ["https://b.com/y.html"]
    assert df.filter(U.url_matches_any(u, [])).count() == df.filter(U.url_matches_any(u, None)).count() == 3
    assert df.filter(U.url_matches_any(u, [r"\.html$", "rel"])).count() == 2
    some = F.array(F.lit("x$"), F.lit("zz"))
    assert df.filter(U.url_matches_any(u, some)).count() == 1
    assert df.filter(U.url_matches_any(u, F.lit(None).cast("array<string>"))).count() == 3
    assert [r[0] for r in df.select(U.robots_url(u)).collect()] == [
        "https://a.b.com/robots.txt", "https://b.com/robots.txt", ""]


REQUIRED = {r"/a/b\.html$": "/a/b.html", "ab+cd": "ab", "ab*cd": "cd", "(abc)?def": "def", "abc|defg": "", "(a|b)xyz": "xyz", "[abc]xyz{2}w": "xyz",
            "x{0,3}yz": "yz", "(?i)abc": "", r"\d+abc": "abc", r"a\/b": "a/b", "": "", "^https?://h/": "://h/", "a{,2}b": "b", "(abc(d)+)efg": "efg",
            r"\babcd\n": "abcd", "[^/]+/page-": "/page-", "a.b": "a", r"[\]x]yy": "yy", "xx{2}": "xx"}


@pytest.mark.parametrize("pattern", list(REQUIRED))
def test_required_text(pattern):
    assert required_text(pattern) == REQUIRED[pattern]


def test_pattern_sets_agree_with_trying_all(spark):
    rng = random.Random(8)
    pieces = ["/item", "/page-", "[0-9]+", ".*", "(a|b)", "x?", "html", r"\.", "$", "^http", "shop"]
    patterns = [(f"s{rng.randrange(12)}", "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))) for _ in range(150)]
    patterns = [(s, p) for s, p in patterns if not p.startswith("^http^")] + [(None, "x"), ("s1", None), ("s2", "#end"), ("s2", "#end")]
    urls = [(n, rng.choice([None, "s99", *[f"s{k}" for k in range(12)]]), "http://shop" + "".join(
        rng.choice(["/item", "/page-", "7", "html", ".", "a", "x", "#end"]) for _ in range(rng.randint(0, 6)))) for n in range(1200)]
    urls += [(1, "s1", None), urls[3], (2, "s2", "")]
    table = Workspace(spark).put(pattern_table(spark.createDataFrame(patterns, "set_id string, pattern string")), "patterns")
    got = filter_patterns(spark.createDataFrame(urls, "n int, set_id string, url string"), table)
    sets = {}
    for s, p in patterns:
        if s and p:
            sets.setdefault(s, []).append(re.compile(p))
    want = [r for r in urls if r[1] not in sets or (r[2] is not None and any(p.search(r[2]) for p in sets[r[1]]))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert table.filter("gram IS NOT NULL").count() > 20 and len(want) < len(urls)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="not a URL pattern"):
        pattern_table(spark.createDataFrame([("s", "(")], "set_id string, pattern string")).collect()


def test_patterns_of_a_column(spark):
    rows = [(["b$"], "ab"), (["x", "a.c"], "zabc"), ([r"(a)\1", "q"], "aa"), ([r"(a)\1", "q"], "q"), ([], "a"), (None, "a"), (["(", ""][1:], "a"), (["b"], "a")]
    found = spark.createDataFrame(rows, "p array<string>, u string").select(url_matches_any(F.col("u"), F.col("p")).alias("m"))
    assert [r.m for r in found.collect()] == [True, True, True, True, True, True, True, False]


def test_links_without_scheme_and_within_the_page(spark):
    bases = ["http://H.org/a/b?q=1#f", "https://h.org/a;p", "http://h.org", "ftp://h.org/x", "/only/path", "mailto:a@b"]
    hrefs = ["//G.org/x", "//g.org", "//g.org/a/../b", "//g.org/a;p", "#f", "#", "?q=2", "?q=2#f", "?", "?#f", "#a#b", "//", "///x", "#a?b", "?a?b#c#d"]
    rows = [(b, h) for b in bases for h in hrefs]
    plain = F.concat(F.lit("\t"), F.col("href"))          # a leading control character takes the long way
    got = spark.createDataFrame(rows, "base string, href string").select(
        U.resolve_link(F.col("base"), F.col("href")).alias("short"), U.resolve_link(F.col("base"), plain).alias("long")).collect()
    assert [r.short for r in got] == [r.long for r in got]


def test_plain_urls_take_the_same_way_as_all_others(spark):
    urls = ["http://h", "http://h/", "https://h:8/a//b", "http://h/a;p/b", "http://h/./a", "http://h/a?", "http://h/a?#", "http://h/a#", "http://h/a?x#y",
            "HTTP://H/A", "http://H/a", "http://h/a b", "http://h/\ta", " http://h/a", "http://h/é", "http://É/a", "", None, "http://h?q", "//h/a"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    plain = U._PLAIN_PATH, U._PLAIN_URL
    fast = [tuple(r) for r in df.select(U.normalize_url(F.col("u")), U.base_parts(F.col("u"))).collect()]
    try:
        U._PLAIN_PATH = U._PLAIN_URL = r"^\x00never\z"
        slow = [tuple(r) for r in df.select(U.normalize_url(F.col("u")), U.base_parts(F.col("u"))).collect()]
    finally:
        U._PLAIN_PATH, U._PLAIN_URL = plain
    assert fast == slow
    for domains in (["h"], ["h/a"], ["h", None], [], [""]):
        fit = df.select(U.url_in_domains(F.col("u"), F.lit(domains).cast("array<string>")), F.array_contains(
            F.lit(domains).cast("array<string>"), U.url_domain(F.col("u")))).collect()
        assert [r[0] for r in fit] == [r[1] for r in fit]


def test_plain_links_leave_the_scan_resolved(spark):
    """Targets put together in the Arrow stage are those of Spark's expressions, over many batches, and plain pages need no others."""
    bases = [*BASES, "https://shop.example.com/a/b", "https://shop.example.com/", "http://h.org/a/b/c/", "http://h.org:8/a", "http://h.org/a?b", "http://h.org//a"]
    hrefs = [*HREFS, "/", "/a/b/", "a/b-c_d/", "../a/b", "//Q.org", "//Q.org/x/", "HTTP://Q.org/X", "?page=2", "#reviews", "", *CLICK_HREFS]
    hrefs = [h for h in hrefs if not re.search('["&<>]', h)]
    rows = [(b, "".join(f'<a href="{h}">' for h in group)) for b in bases for group in [*([h] for h in hrefs), [], ["/a", "b", "/a", "#", "../c"]]]
    rows = rows * 2 + [(f"https://shop.example.com/part/{i}", '<a href="?page=2"><a href="../line/1">') for i in range(3000)]
    frame = spark.createDataFrame(rows, "url string, html string").coalesce(1)
    want = page_hrefs(frame).select("url", link_targets(F.col("hrefs"), F.col("url")).alias("targets"))
    assert page_targets(frame).collect() == want.collect()
    plain = page_hrefs(frame.filter(F.col("url").contains("/part/")), skipped=CLICK_HREFS)
    assert plain.filter("targets IS NULL OR hrefs IS NOT NULL").count() == 0


def test_plain_robots_paths_take_the_same_way_as_all_others(spark):
    urls = [*HREFS, "http://h", "http://h/", "https://h:8/a//b", "http://h//a", "http://h/a;p/b", "http://h/a;", "http://h/./a", "http://h/~a/b-c_d.e/",
            "http://h/a?x#y", "HTTP://H/A", "http://h/a%2fb", "http://h/a+b", "http://h/a b", "http://h/\ta", "http://h/a\n", "http://h/é", "ftp://h/a", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    plain, fast = U._PLAIN_ROBOTS, df.select(U.robots_path(F.col("u"))).collect()
    try:
        U._PLAIN_ROBOTS = r"^\x00never\z"
        assert fast == df.select(U.robots_path(F.col("u"))).collect()
    finally:
        U._PLAIN_ROBOTS = plain


def test_patterns_are_joined_once_per_list(spark):
    lists = [["b$"], ["x", "a.c"], [r"(a)\1", "q"], [], None, ["x", None], [None]]
    rows = [(p, u) for p in lists for u in ("ab", "zabc", "aa", "q", "")]
    df = spark.createDataFrame(rows, "p array<string>, u string").withColumn("j", U.joined_patterns(F.col("p")))
    assert all(bool(m) == bool(n) for m, n in df.select(U.url_matches_any(F.col("u"), F.col("p")), U.url_matches_joined(F.col("u"), F.col("j"))).collect())
    assert [r.j.joined for r in df.dropDuplicates(["p"]).filter("size(p) = 2 AND p[0] = 'x' AND p[1] = 'a.c'").collect()] == ["(?:x)|(?:a.c)"]
