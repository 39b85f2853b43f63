"""The crawl against a plain breadth-first walk on random link graphs."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.plans import crawl as C
from pagemill.sources.robots import read_robots
from pagemill.storage import Workspace, shared_folder


def graph(seed, n=60):
    rng = random.Random(seed)
    return {f"http://h{i % 3}/p{i}": sorted({f"http://h{j % 3}/p{j}" for j in (rng.randrange(n + 8) for _ in range(rng.randint(0, 4)))})
            for i in range(n)}


def corpus(spark, links):
    rows = [(u, "".join(f'<a href="{t}">x</a>' for t in ts) + '<a href="#">c</a><a>n</a>', 200) for u, ts in links.items()]
    return spark.createDataFrame(rows, "url string, html string, status int")


def walk(links, start, limit, allowed, redirects=()):
    """``{url: depth}`` of everything found, with leftover URLs at limit + 1."""
    found, level, depth = {start: 0}, [start], 0
    jumps = {}
    for a, b in redirects:
        jumps.setdefault(a, []).append(b)
    while level and depth <= limit:
        queue = list(level)
        while queue:                                  # clicks stay on the level
            u = queue.pop()
            for t in jumps.get(u, []) if u in links else []:
                if t not in found:
                    found[t] = depth
                    level.append(t)
                    queue.append(t)
        following = []
        for u in level:
            for t in links.get(u, []):
                if t not in found and allowed(t):
                    found[t] = depth + 1
                    following.append(t)
        level, depth = following, depth + 1
    return found


def found(result):
    return {(r.seed_id, r.url): r.depth for r in result.found.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_many_seeds_with_their_own_limits(spark, seed):
    links = graph(seed)
    settings = [(0, "http://h0/p0", 9, ["h0", "h1", "h2"], None), (1, "HTTP://H1/p1", 2, ["h0", "h1"], None),
                (2, "http://h2/p2", 3, ["h2", "h0", "h1"], ["[02468]$"]), (3, "http://h0/p0", 0, ["h0"], None)]
    seeds = spark.createDataFrame(settings, "seed_id int, url string, max_depth int, allowed_domains array<string>, url_patterns array<string>")
    result = C.crawl(C.make_seeds(seeds), corpus(spark, links))
    want = {}
    for i, url, limit, domains, patterns in settings:
        def ok(t, domains=domains, patterns=patterns):
            return t.split("/")[2] in domains and (not patterns or t[-1] in "02468")
        want.update({(i, u): d for u, d in walk(links, url.lower(), limit, ok).items()})
    assert found(result) == want
    limits = {s[0]: s[2] for s in settings}
    assert {(r.seed_id, r.url) for r in result.to_visit.collect()} == {k for k, d in want.items() if d > limits[k[0]]}
    assert {(r.seed_id, r.url) for r in result.crawled.collect()} == {
        k for k, d in want.items() if d <= limits[k[0]] and k[1] in links}
    parents = [r for r in result.found.collect() if r.depth > 0]
    assert all(r.url in links[r.src_url] and want[r.seed_id, r.src_url] == r.depth - 1 for r in parents)
    totals = {r.seed_id: r for r in C.crawl_summary(result).collect()}
    kept = C.crawl(C.make_seeds(seeds), corpus(spark, links), keep_refused=True)
    assert {r.seed_id: r for r in C.crawl_summary(kept).collect()} == totals
    for i, s in limits.items():
        mine = {u: d for (j, u), d in want.items() if j == i}
        got = {u for u, d in mine.items() if d <= s and u in links}
        assert totals[i].allowed == len(mine) and totals[i].fetched == len(got)
        assert totals[i].left_over == sum(d > s for d in mine.values())
        assert totals[i].discovered == len(set(mine) | {t for u in got for t in links[u]})


def test_redirects_join_the_same_level(spark):
    links = graph(3)
    pairs = [("http://h0/p0", "http://h1/p40"), ("http://h1/p40", "http://x/outside"), ("http://x/outside", "http://h0/p3"),
             ("http://h2/p50", "http://h2/p53"), ("http://h0/p9", "http://h0/p12")]
    domains = ["h0", "h1", "h2"]
    seeds = spark.createDataFrame([(0, "http://h0/p0")], "seed_id int, url string")
    result = C.crawl(C.make_seeds(seeds, allowed_domains=domains, max_depth=9), corpus(spark, links),
                     redirects=spark.createDataFrame(pairs, "src_url string, dst_url string"))
    want = walk(links, "http://h0/p0", 9, lambda t: t.split("/")[2] in domains, pairs)
    assert found(result) == {(0, u): d for u, d in want.items()}


def test_robots_of_the_seed_site_rule_the_crawl(spark):
    links = {"http://h0/": ["http://h0/a1", "http://h0/b1", "http://h1/a2"], "http://h0/b1": ["http://h0/b2"]}
    robots = read_robots(spark.createDataFrame(
        [("h0", "User-agent: *\nDisallow: /a\nCrawl-delay: 7\n", 200), ("h1", "", 403)], "host string, body string, status int"))
    rows = [(0, "http://h0/", False), (1, "http://h0/", True), (2, "http://h1/", False)]
    seeds = C.make_seeds(spark.createDataFrame(rows, "seed_id int, url string, ignore_robots_txt boolean"), allowed_domains=["h0", "h1"])
    result = C.crawl(seeds, corpus(spark, {**links, "http://h1/": ["http://h0/b1"]}), robots)
    got = {}
    for s, u in found(result):
        got.setdefault(s, set()).add(u)
    assert got[0] == {"http://h0/", "http://h0/b1", "http://h0/b2"}
    assert got[1] == {"http://h0/", "http://h0/a1", "http://h0/b1", "http://h0/b2", "http://h1/a2"}
    assert got[2] == {"http://h1/"}
    assert {r.seed_id: r.crawl_delay for r in result.seeds.collect()} == {0: 7.0, 1: 1.0, 2: 1.0}


def test_copies_and_bad_responses(spark):
    rows = [(1, "http://h/", '<a href="old">x</a>', 200), (2, "http://h/", '<a href="new">x</a>', 200), (3, "http://h/new", "", -1),
            (4, "http://h/old", "", 200), (5, "http://other/", "", 200)]
    pages = spark.createDataFrame(rows, "n int, url string, html string, status int")
    seeds = spark.createDataFrame([(0, "http://h/")], "seed_id int, url string")
    result = C.crawl(C.make_seeds(seeds), pages, arrival="n")
    assert {r.url: r.fetched for r in result.visited.collect()} == {"http://h/": True, "http://h/new": False}
    # Pages of other sites were never looked at.
    assert {r.url for r in result.index.collect()} == {"http://h/", "http://h/old"}


def test_fragments_are_found_on_their_page(spark):
    rows = [("http://h/", '<a href="/b#x">x</a><a href="/c#y">y</a><a href="/d#z">z</a>'), ("http://h/b", '<a href="/e">e</a>'),
            ("http://h/c#y", '<a href="/f">f</a>'), ("http://h/c", '<a href="/g">g</a>'), ("http://h/e", ""), ("http://h/f", "")]
    pages = spark.createDataFrame(rows, "url string, html string")
    result = C.crawl(C.make_seeds(spark.createDataFrame([(0, "http://h/#start")], "seed_id int, url string")), pages)
    assert {r.url: r.page for r in result.crawled.collect()} == {
        "http://h/#start": "http://h/", "http://h/b#x": "http://h/b", "http://h/c#y": "http://h/c#y", "http://h/e": "http://h/e",
        "http://h/f": "http://h/f"}
    assert {r.url for r in result.visited.filter("NOT fetched").collect()} == {"http://h/d#z"}
    assert {(r.url, r.html) for r in result.pages(pages).collect()} == {
        ("http://h/b#x", rows[1][1]), ("http://h/c#y", rows[2][1]), ("http://h/e", ""), ("http://h/f", "")}
    assert [r.fetched for r in C.crawl_summary(result).collect()] == [5]


def test_no_seed(spark):
    seeds = spark.createDataFrame([], "seed_id int, url string")
    assert C.crawl(C.make_seeds(seeds), corpus(spark, graph(1))).found.count() == 0


def test_workspace_uses_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named and Workspace(spark).path.startswith(named)
    a = Workspace(spark)
    back = a.put(spark.range(3), "t")
    assert back.count() == 3 and Workspace(spark).path != a.path


def test_hot_target_is_combined_before_the_shuffle(spark):
    seeds = spark.createDataFrame([(0, "http://h0/p0")], "seed_id int, url string")
    settings = C.attach_robots(C.make_seeds(seeds, allowed_domains=["h0"]), None)
    hits = spark.range(50).select(F.lit(0).alias("seed_id"), F.array(F.lit("http://h0/"), F.lit("http://x/")).alias("targets"))
    children = C.child_urls(hits, settings)
    assert [r.url for r in children.collect()] == ["http://h0/"]
    plan = children._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2          # partial before, final after the exchange


def test_only_the_frontier_moves(spark):
    ws, limit = Workspace(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    index = ws.put_bucketed(spark.createDataFrame([("a", 200, ["b"]), ("b", 200, [])], "url string, status int, targets array<string>"), "index", "url")
    met = ws.put_bucketed(spark.createDataFrame([(0, "a")], "seed_id int, url string"), "met", "seed_id", "url")
    met = ws.put_bucketed(spark.createDataFrame([(0, "b")], "seed_id int, url string"), "met", "seed_id", "url")
    fresh = ws.put(spark.createDataFrame([(0, "b"), (1, "b")], "seed_id int, url string"), "fresh")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined, want in ((fresh.join(index, "url"), 2), (C.unseen(fresh, met), 1)):
            assert joined.count() == want
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_corpus_urls_are_normalised(spark):
    pages = spark.createDataFrame([("HTTP://Host.test/", '<a href="x">x</a>'), ("http://HOST.test/x", "")], "url string, html string")
    result = C.crawl(C.make_seeds(spark.createDataFrame([(0, "http://host.test/")], "seed_id int, url string")), pages)
    assert {r.url for r in result.crawled.collect()} == {"http://host.test/", "http://host.test/x"}
    assert {r.url for r in result.pages(pages).collect()} == {"http://host.test/x"}


def test_levels_keep_what_the_index_tells_of_a_page(spark):
    pages = [("http://h/", 200, ["http://h/a#x", "http://h/none"], ["r"]), ("http://h/a", 200, ["http://h/late"], ["s", "t"]), ("http://h/late", 200, [], ["u"])]
    index = spark.createDataFrame(pages, "url string, status int, targets array<string>, rows array<string>")
    seeds = C.make_seeds(spark.createDataFrame([(0, "http://h/"), (1, "http://h/a")], "seed_id int, url string"), max_depth=1)
    result = C.crawl(seeds, index, index=index)
    assert sorted((r.seed_id, r.url, r.page, r.rows) for r in result.answers.collect()) == [
        (0, "http://h/", "http://h/", ["r"]), (0, "http://h/a#x", "http://h/a", ["s", "t"]), (1, "http://h/a", "http://h/a", ["s", "t"]),
        (1, "http://h/late", "http://h/late", ["u"])]
    assert result.index.columns == ["url", "status", "targets"] and "rows" not in result.crawled.columns
