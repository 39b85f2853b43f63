"""The tree builder, selectors and values on small pages."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagemill.functions import dom
from pagemill.functions.dom import node_table, page_hrefs, shred_pages
from pagemill.functions.selectors import parse_selector
from pagemill.functions.values import inner_markup
from pagemill.operators.inside import join_inside
from pagemill.operators.select import node_filter, select_css, select_path, with_text

SHELVES = """<section class="wing">
<ul class="shelf low"><li class="slot"> atlas </li></ul>
<ol class="shelf"><li class="slot"> globe </li></ol><em class="slot">map</em></section
"""
TARIFF = '<ul class="tariff now"><li class="sum due">7,25 €</li><li class="sum">0,10 €</li></ul>'
LISTS = """<ol id=ours><li class=line><b class=sum>1</b></ol>
<ol id=theirs><li class=line><b class=sum>2</b><li class=line><b class=sum>3</b></ol>"""
BOXES = '<div class="box" id=o><div class="box" id=i><span class="item">x</span></div></div>'


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "k int, html string")


def texts(spark, html, selector):
    rows = with_text(select_css(shred_pages(pages(spark, html)), selector)).orderBy("match_ord").collect()
    return [r.text for r in rows]


def walk(spark, html, *steps, distinct=False):
    rows = with_text(select_path(shred_pages(pages(spark, html)), list(steps), distinct)).orderBy("match_ord").collect()
    return [r.text for r in rows]


def test_steps_leave_decoys_and_survive_a_broken_end(spark):
    assert walk(spark, SHELVES, ".wing", ".shelf.low", ".slot") == ["atlas"]
    found = select_css(shred_pages(pages(spark, SHELVES)), ".shelf.low")
    assert [r.c for r in found.select(F.element_at("node.attrs", F.lit("class")).alias("c")).collect()] == ["shelf low"]


def test_values_beside_decoys(spark):
    assert texts(spark, TARIFF, ".tariff li.due") == ["7,25 €"]
    assert walk(spark, LISTS, "#ours", ".line", ".sum") == ["1"]


def test_bag_semantics(spark):
    assert walk(spark, BOXES, ".box", ".item") == ["x", "x"]
    assert walk(spark, BOXES, ".box", ".item", distinct=True) == ["x"]
    assert texts(spark, BOXES, ".box .item") == ["x"]
    assert walk(spark, BOXES) == []


EDGE = {
    "": ["html", "head", "body"],
    "only text": ["html", "head", "body"],
    "<p><b>a<p>b": ["html", "head", "body", "p", "b", "p"],
    '<script>var t="</p>"</script><p>x': ["html", "head", "script", "body", "p"],
    "<ul><li>1<li>2</ul>": ["html", "head", "body", "ul", "li", "li"],
    "<table><tr><td>1<td>2<tr><td>3</table>": [
        "html", "head", "body", "table", "tbody", "tr", "td", "td", "tr", "td"],
    "<DIV ID=a ID=b>x</DIV></div></span>": ["html", "head", "body", "div"],
    "<select><option>1<option>2</select>": ["html", "head", "body", "select", "option", "option"],
    "<a href=1>x<a href=2>y</a>": ["html", "head", "body", "a", "a"],
    "<dl><dt>a<dd>b<dt>c</dl>": ["html", "head", "body", "dl", "dt", "dd", "dt"],
}


def test_edge_pages(spark):
    rows = shred_pages(pages(spark, *EDGE)).select("k", F.transform("nodes", lambda n: n["tag"]).alias("t")).collect()
    assert {list(EDGE)[r.k]: r.t for r in rows} == EDGE


def test_text_is_collected_across_entities_comments_and_breaks(spark):
    html = "<div>  a&amp;b<!-- no --><br>c &lt; d<b> e</b> \n</div><p>&nbsp; &eacute;t&eacute; </p>"
    assert texts(spark, html, "div, p") == ["a&bc < d e", "été"]


def test_inner_markup_counts_code_points(spark):
    shredded = shred_pages(pages(spark, "<p>é😀<i>ü</i> <b>x<!-- c --></b></p>"), keep_html=True)
    out = shredded.select("html", F.explode("nodes").alias("n")).filter("n.tag in ('p','b','i')").select(
        inner_markup(F.col("n"), F.col("html")).alias("m")).collect()
    assert [r.m for r in out] == ["é😀<i>ü</i> <b>x<!-- c --></b>", "ü", "x<!-- c -->"]


SELECTORS = {
    "div": "d1 d2 d3", "*.a": "d1 p1", "#p1": "p1", "[data-x]": "d2 d3", "[data-x=1]": "d2", "[data-x='2 3']": "d3",
    "[data-x~=3]": "d3", "[data-x^=2]": "d3", "[data-x$='3']": "d3", "[data-x*=' ']": "d3", "[lang|=en]": "p2 p3",
    "div > p": "p1 p2 p3", "div p": "p1 p2 p3", "p + p": "p2 p3", "#p1 ~ p": "p2 p3", "p:first-child": "p1",
    "p:nth-child(2n)": "p2", "p:nth-child(-n+2)": "p1 p2", "p:not(.a)": "p2 p3", "p:not([lang])": "p1",
    "#d1 > div, #d1 > p": "p1 p2 p3 d2", "div div": "d2", ".a .a": "p1", "[data-x^='']": "", "p:nth-child(odd)": "p1 p3",
    "div:has(p)": "d1", "div:has(> [data-x])": "d1", "p:has(+ p)": "p1 p2", "p:has(~ div)": "p1 p2 p3", "body :has(div)": "d1",
    "div:has(p + p:not(.a))": "d1", "div:has(p > p, > div:empty)": "d1", ":is(#p1, #d3)": "p1 d3", "div:not(:has(p), .q)": "d2 d3",
    "div:last-child": "d2 d3", "p:last-child": "", "p:last-of-type": "p3", "p:first-of-type": "p1", "div:only-of-type": "d2",
    "div :only-of-type": "d2", "p:nth-of-type(2n+1)": "p1 p3", "p:nth-last-of-type(1)": "p3", "p:nth-last-child(-n+2)": "p3",
    "div:empty": "d2 d3", "p:empty": "", "div:only-child": "", "div:nth-last-child(1):not([data-x='2 3'])": "d2",
}
SELECTOR_PAGE = """<div id=d1 class="a b"><p id=p1 class="\ta\nc">1</p><p id=p2 lang=en>2</p><p id=p3 lang=en-US>3</p>
<div id=d2 data-x=1></div></div><div id=d3 data-x="2 3"></div>"""


@pytest.mark.parametrize("selector", list(SELECTORS))
def test_selector(spark, selector):
    found = select_css(shred_pages(pages(spark, SELECTOR_PAGE)), selector).orderBy("match_ord")
    ids = [r.i for r in found.select(F.element_at("node.attrs", F.lit("id")).alias("i")).collect()]
    assert " ".join(ids) == SELECTORS[selector]


@pytest.mark.parametrize("selector", ["", "p::before", "p:hover", "p >", "> p", "a,,b", "p:not(a b)", "(x)", "p:nth-child(x)",
                                      "p:has()", "p:has(a", "p:nth-child", "p:empty(x)", "p:not(a,)", "p:has(:hover)"])
def test_unsupported_selector_is_refused(selector):
    with pytest.raises(ValueError):
        parse_selector(selector)


def random_pages(n, seed):
    rng = random.Random(seed)
    bits = ["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<a href=x>", "</a>", "t &amp; u", "<br>",
            "<table>", "<tr>", "<td>", "</table>", "<!-- c -->", "<script>a<b</script>", "<h1>", "</h1>", "<", "é",
            '<a href="y" class="k l">', "<option>", "</span>", "<title>q</title>", "<a>", "<body>", "</body>", '<p title="<a>">', "<a"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_encoding_is_a_forest(spark):
    rows = shred_pages(pages(spark, *random_pages(400, 7))).collect()
    for r in rows:
        counts: dict[int, int] = {}
        for i, n in enumerate(r.nodes):
            assert n.pre == i <= n.last < len(r.nodes)
            assert 0 <= n.c0 <= n.c1 <= len(r.chunks) and n.h0 <= n.h1
            if n.parent < 0:
                assert i == 0 and n.level == 0
                continue
            up = r.nodes[n.parent]
            assert n.parent < i and n.last <= up.last and n.level == up.level + 1
            assert up.c0 <= n.c0 and n.c1 <= up.c1
            counts[n.parent] = counts.get(n.parent, 0) + 1
            assert n.sib == counts[n.parent]
            assert (n.prev == -1) == (n.sib == 1)
            if n.prev >= 0:
                assert r.nodes[n.prev].parent == n.parent and r.nodes[n.prev].last == i - 1
        assert r.nodes[0].last == len(r.nodes) - 1


def test_text_equals_the_standard_parser(spark):
    """All text of a page outside raw elements, compared with html.parser, on the driver's pages."""
    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out = []

        def handle_data(self, data):
            self.out.append(data)

    corpus = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    got = {r.page_id: "".join(r.chunks) for r in shred_pages(corpus).select("page_id", "chunks").collect()}
    for r in corpus.collect():
        p = Words()
        p.feed(r.html)
        p.close()
        assert got[r.page_id] == "".join(p.out)


def test_light_link_scan_agrees_with_the_tree(spark):
    frame = pages(spark, *random_pages(2000, 11))
    light = {r.k: r.hrefs for r in page_hrefs(frame).collect()}
    tree = shred_pages(frame).select("k", F.transform(F.filter("nodes", lambda n: n["tag"] == "a"), lambda n: F.element_at(
        n["attrs"], F.lit("href"))).alias("hrefs")).collect()
    assert light == {r.k: r.hrefs for r in tree}


def test_joins_over_a_node_table_agree_with_arrays(spark):
    frame = pages(spark, *random_pages(300, 3))
    nodes = node_table(shred_pages(frame), "k").persist()
    inner = join_inside(join_inside(node_filter(nodes, "div, ul"), node_filter(nodes, "p, li"), "k").drop("outer_pre"),
                        node_filter(nodes, "a, b"), "k")
    joined = sorted((r.k, r.pre) for r in inner.select("k", "pre").collect())
    found = select_path(shred_pages(frame), ["div, ul", "p, li", "a, b"]).select("k", "node.pre").collect()
    assert joined == sorted((r.k, r.pre) for r in found)
    assert joined


def test_batches_stay_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dom, "BATCH_PAGES", 2)
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4, 5], "html": ["<p>x"] * 4 + [None]})
    out = list(dom.shred_batches("html", None, False)(iter([batch])))
    assert [b.num_rows for b in out] == [2, 2, 1]
    assert [b.column("k").to_pylist() for b in out] == [[1, 2], [3, 4], [5]]


#: Selectors next to what they mean: n is a node, t the page's nodes.
MEANS = {
    "div p": lambda n, t: n.tag == "p" and any(a.tag == "div" for a in above(n, t)),
    "div b a": lambda n, t: n.tag == "a" and any(
        b.tag == "b" and any(d.tag == "div" for d in above(b, t)) for b in above(n, t)),
    "ul p ~ b, td a": lambda n, t: (n.tag == "b" and any(
        m.tag == "p" and m.parent == n.parent and m.pre < n.pre and any(u.tag == "ul" for u in above(m, t)) for m in t)) or (
        n.tag == "a" and any(a.tag == "td" for a in above(n, t))),
    "ul a, td a, p a": lambda n, t: n.tag == "a" and any(a.tag in ("ul", "td", "p") for a in above(n, t)),
    "p ~ b, a ~ b": lambda n, t: n.tag == "b" and any(m.tag in ("p", "a") and m.parent == n.parent and m.pre < n.pre for m in t),
    ":has(b)": lambda n, t: any(m.tag == "b" for m in below(n, t)),
    ":has(> a, > b)": lambda n, t: any(m.tag in "ab" and m.parent == n.pre for m in t),
    "p:has(+ p)": lambda n, t: n.tag == "p" and any(m.tag == "p" and m.prev == n.pre for m in t),
    "b:has(~ a)": lambda n, t: n.tag == "b" and any(m.tag == "a" and m.parent == n.parent and m.pre > n.pre for m in t),
    ":has(p b)": lambda n, t: any(m.tag == "p" and any(k.tag == "b" for k in below(m, t)) for m in below(n, t)),
    "div > :last-child": lambda n, t: n.parent >= 0 and t[n.parent].tag == "div" and not later(n, t),
    "body :only-child": lambda n, t: n.sib == 1 and not later(n, t) and any(a.tag == "body" for a in above(n, t)),
    "p:nth-of-type(2n)": lambda n, t: n.tag == "p" and len([m for m in t if m.parent == n.parent and m.tag == "p" and m.pre <= n.pre]) % 2 == 0,
    "b:last-of-type": lambda n, t: n.tag == "b" and not any(m.tag == "b" for m in later(n, t)),
    ":nth-last-child(2)": lambda n, t: len(later(n, t)) == 1,
    "b:empty": lambda n, t: n.tag == "b" and n.last == n.pre and n.c0 == n.c1,
}


def above(n, t):
    while n.parent >= 0:
        n = t[n.parent]
        yield n


def below(n, t):
    return t[n.pre + 1:n.last + 1]


def later(n, t):
    return [m for m in t if m.parent == n.parent and m.pre > n.pre]


@pytest.fixture(scope="module")
def random_trees(spark):
    frame = shred_pages(pages(spark, *random_pages(150, 5)))
    return frame, {r.k: r.nodes for r in frame.collect()}


@pytest.mark.parametrize("selector", list(MEANS))
def test_selector_on_random_pages(random_trees, selector):
    frame, trees = random_trees
    got = sorted((r.k, r.pre) for r in select_css(frame, selector).select("k", "node.pre").collect())
    assert got == [(k, n.pre) for k, t in sorted(trees.items()) for n in t if MEANS[selector](n, t)]
    assert got


def test_deep_and_wide_pages_are_cheap(spark):
    deep = shred_pages(pages(spark, "<b>" * 8000 + "<i>x</i>"), [])
    wide = shred_pages(pages(spark, "<div><p><b>x</b></p></div>" * 20_000), [])
    start = time.perf_counter()
    assert select_css(deep, "b b i").count() == 1 and select_css(deep, "b:has(i)").count() == 8000
    assert select_path(deep, ["b", "i"]).count() == 8000
    assert select_css(wide, "body div b").count() == 20_000 and select_path(wide, ["div", "p", "b"]).count() == 20_000
    assert select_css(wide, "div:has(b):nth-of-type(2n)").count() == 10_000
    assert time.perf_counter() - start < 60


def test_containment_pairs_only(spark):
    """20,000 boxes, nested and side by side, each with its own link."""
    nested = spark.range(20_000).select(F.lit("deep").alias("k"), F.col("id").cast("int").alias("pre"), F.lit(40_000).alias("last"))
    flat = spark.range(200_000).select(F.lit("flat").alias("k"), (F.col("id") * 2).cast("int").alias("pre"),
                                       (F.col("id") * 2 + 1).cast("int").alias("last"))
    unkeyed = spark.range(1).select(F.lit(None).cast("string").alias("k"), F.lit(0).alias("pre"), F.lit(9).alias("last"))
    links = [("deep", 30_000), ("deep", 10_000), ("none", 5), (None, 3)]
    inner = spark.createDataFrame(links, "k string, pre int").union(flat.select("k", F.col("pre") + 1))
    start = time.perf_counter()
    found = join_inside(nested.union(flat).union(unkeyed), inner.withColumn("attrs", F.create_map(F.lit("a"), F.col("k"))), "k")
    counts = {r.k: (r["count"], r.s) for r in found.groupBy("k").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col("pre") - F.col("outer_pre")).alias("s")).collect()}
    assert counts == {"deep": (30_000, sum(range(10_001, 30_001)) + sum(range(1, 10_001))), "flat": (200_000, 200_000)}
    assert time.perf_counter() - start < 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_segments_cut_long_pages(spark):
    frame = shred_pages(pages(spark, *random_pages(200, 3)))
    nodes = node_table(frame, "k").persist()
    outer, inner = node_filter(nodes, "div, ul, body"), node_filter(nodes, "a, b, p")
    want = sorted((r.k, r.pre, r.outer_pre) for r in outer.select("k", F.col("pre").alias("outer_pre"), "last").join(
        inner.select("k", "pre"), "k").filter("pre > outer_pre AND pre <= last").collect())
    for segment in (1, 3, None):
        got = join_inside(outer, inner, "k", segment=segment)
        assert sorted((r.k, r.pre, r.outer_pre) for r in got.collect()) == want
    assert got.columns == [*inner.columns, "outer_pre"]
    assert join_inside(outer.limit(0), inner, "k").count() == join_inside(outer, inner.limit(0), "k").count() == 0


def test_plan_has_no_shuffle(spark):
    df = select_path(shred_pages(pages(spark, SHELVES)), [".wing", ".slot"])
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_unquoted_value_keeps_its_slash(spark):
    from pagemill.operators.links import extract_links
    pages = spark.createDataFrame([(1, "http://h/", "<a href=foo/>x</a><a href=/bar/>y</a><a href=q>z</a>")], "page_id long, url string, html string")
    assert [r["href"] for r in extract_links(pages, "page_id").orderBy("ord").collect()] == ["foo/", "/bar/", "q"]


def test_stray_end_tags_on_a_deep_page_are_cheap(spark):
    html = "<b>" * 10_000 + "x</i></u>" * 10_000
    start = time.perf_counter()
    row = shred_pages(pages(spark, html)).select(F.size("nodes").alias("n"), F.size("chunks").alias("c")).first()
    assert (row.n, row.c) == (10_003, 10_000) and time.perf_counter() - start < 60



def test_long_lists_with_later_siblings_are_cheap(spark):
    items = 100_000
    html = "<ul><li>a</li><li class=m>b</li>" + "<li>c</li>" * items + "</ul><ol><li>d</li><li class=m>e</li><li>f</li></ol>"
    shredded = shred_pages(pages(spark, html), [])
    start = time.perf_counter()
    assert select_css(shredded, ".m ~ li").count() == items + 1
    assert select_css(shredded, ".m ~ li ~ li").count() == items - 1
    assert select_path(shredded, ["ol", ".m ~ li"]).count() == 1 and select_css(shredded, ".none ~ li").count() == 0
    assert time.perf_counter() - start < 60


def test_plain_pages_are_read_without_python(spark):
    """Spark's expressions and the scanner agree, also on tags that only look plain."""
    rows = ['<!DOCTYPE html><html><title>a &lt; b</title><a href="/x">t</a><a href="">e</a>', '<title>t</title><p class=c><a href="/y" id="i">', "<a>n</a>",
            '<a id="i" href="/z">', '<a href="/a&amp;b">', '<!-- <a href="/no"> --><a href="/c">', '<script><a href="/no"></script><a href="/d">',
            '<title><a href="/no"></title>', '<a href="/e"', "<a href='/f'>", "x < y <a href=\"/g\">", '<p title="<a href="/no">', "", "no tags",
            '<A HREF="/h">', '<a  href="/i">', '<abbr title="v"><a href="/j"></abbr></a>', '<a href="/k"/>', '<a href="/l\n2">', None]
    frame = spark.createDataFrame(list(enumerate(rows)), "id int, html string")
    assert {r.id: r.hrefs for r in page_hrefs(frame).collect()} == {i: dom._hrefs(h or "") for i, h in enumerate(rows)}
    assert frame.filter(~F.col("html").rlike(dom._ODD_TAG)).count() > 3


def test_only_pages_that_may_match_are_parsed(spark, monkeypatch):
    from pagemill.operators import extract as X
    from pagemill.sources.specs import Rule
    sources = ['<p><a href="x">l</a></p>', '<article class="ware"><h2>n</h2></article>', "<article class='ware'><H2>odd</H2></article>",
               '<article class="w&#97;re"><h2>e</h2></article>', '<div class="ware"><h2>out</h2></div>', "", '<h2>no</h2><a href="/y">z</a>']
    pages = spark.createDataFrame([(f"http://h/{i}", s) for i, s in enumerate(sources)], "url string, html string")
    rules = [Rule(0, "n", ("article.ware", "h2"), collect_text=True)]

    def rows():
        return sorted((r.url, r.targets, r.rows) for r in X.pages_and_links(pages, rules).collect())

    got = rows()
    sets = pages.withColumn("sets", F.when(F.col("url") != "http://h/0", F.array(F.lit(7))))
    found = sorted((r.url, r.targets, r.found) for r in X.pages_for_sets(sets, {7: rules}).collect())
    assert pages.filter(X.without_matches(rules)).count() == 4
    monkeypatch.setattr(X, "without_matches", lambda rules: None)
    assert rows() == got and [len(r[2]) for r in got] == [0, 1, 1, 1, 0, 0, 0]
    assert sorted((r.url, r.targets, r.found) for r in X.pages_for_sets(sets, {7: rules}).collect()) == found
    assert X.required_texts("a, b") == X.required_texts("h2:not(.x)") == X.required_texts("tbody") == set()


def test_plain_end_tags_are_read_without_a_pattern(monkeypatch):
    """They close the innermost element as any other form of the tag does."""
    def tree(source):
        out = dom._Batch()
        dom._add_page(out, source, None)
        return out.ints, out.tag, out.chunks, out.hrefs

    class Counting:
        seen = 0

        def match(self, source, at):
            Counting.seen += source.startswith("</", at)
            return plain.match(source, at)

    plain = dom._PLAIN_TAG
    monkeypatch.setattr(dom, "_PLAIN_TAG", Counting())
    page = '<body><h1>H</h1><ul><li><a href="x">l</a><a href="y">m</a><li>n</li></ul><p>q<b>r</b><a>s<a href="z">t</a></p></body>'
    fast = tree(page)
    assert Counting.seen == 1                    # only the end of the body
    assert fast == tree(re.sub("</([a-z0-9]+)>", lambda m: f"</{m[1].upper()}>", page)) and Counting.seen > 8
    assert fast[3] == ["x", "y", None, "z"]


def test_parsed_pages_leave_the_scan_resolved(spark):
    """Links of pages with and without a tree, over many batches, are those of Spark's expressions; one stage reads all pages."""
    from pagemill.operators import extract as X
    from pagemill.operators.links import anchor_hrefs, link_targets
    from pagemill.sources.specs import Rule
    bodies = ['<p><a href="x">l</a></p>', '<h2>n</h2><a href="../y">z</a><a href="../y">z</a><a>no</a><a href="#">c</a>', "<h2><a HREF='HTTP://Q.r/A?b#c'>o",
              '<a href="mailto:a@b">m</a>', '<h2>e</h2><a href="">e</a><a href="a&amp;b">f</a>', "", '<a href="?q=1">q</a><a>x', "<h2>no links</h2>"]
    pages = spark.createDataFrame([(f"http://h/d/{i}", i, bodies[i % len(bodies)]) for i in range(3000)], "url string, n int, html string").coalesce(1)
    rules = [Rule(0, "n", ("h2",), collect_text=True)]
    want = shred_pages(pages).select("url", "n", link_targets(anchor_hrefs(F.col("nodes")), F.col("url")).alias("targets"))
    got = X.pages_and_links(pages, rules, "n")
    assert got.select("url", "n", "targets").collect() == want.collect()
    assert [len(r.rows) for r in got.orderBy("n").limit(8).collect()] == [0, 1, 1, 0, 1, 0, 0, 1]
    linked = X.linked_pages(pages, rules)
    assert linked.filter("n < 8 AND size(nodes) = 0").count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
