"""Extraction to tables, ranks over hot groups, layouts, sinks and streams."""

import csv
import json
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pagemill import catalog
from pagemill.operators import chunks as K
from pagemill.operators import reshape as R
from pagemill.operators.extract import (
    apply_rules, drop_seed_pages, extract_lines, extract_strided, extract_table, shred_rules)
from pagemill.operators.ranks import group_rank, running_total
from pagemill.functions.values import register_value
from pagemill.operators.schedule import crawl_schedule, crawl_timeline
from pagemill.plans import crawl as C
from pagemill.plans.job import run_job
from pagemill.plans.jobs import run_jobs
from pagemill.sinks import writers as S
from pagemill.sources import pages as P
from pagemill.sources.pages import failed_fetches, fetch_pages, latest_pages, response_gate, status_report
from pagemill.sources.specs import Rule, load_rules, parse_specs, spec_rules
from pagemill.storage import Workspace
from pagemill.streaming import pages as T

SHOP = [("u0", '<h1>A, "x"</h1><p class=price>1</p><p class=price>2</p><a href=k>t\n</a>'),
        ("u1", "<h1>B</h1>"), ("u2", "<p class=price>3</p>"), ("u3", "")]
RULES = [Rule(0, "Name", ("h1",), collect_text=True, ordinal=1), Rule(1, "Price", (".price",), collect_text=True, ordinal=0),
         Rule(2, "Link.to", ("a",), collect_text=True, attr_name="href", ordinal=2), Rule(3, "none", ("p",), ordinal=3)]


def shop(spark):
    return shred_rules(spark.createDataFrame(SHOP, "url string, html string"), RULES)


def test_aligned_rows(spark):
    got = extract_table(shop(spark), RULES)
    assert got.columns == ["url", "row_ord", "Price", "Name", "Link.to", "Link.to href"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == [("u0", 1, "1", 'A, "x"', "t", "k"), ("u0", 2, "2", None, None, None), ("u1", 1, None, "B", None, None),
                    ("u2", 1, "3", None, None, None)]
    cells = apply_rules(shop(spark), RULES)
    again = R.reshape_aligned(cells, ["Price", "Name", "Link.to", "Link.to href"])
    assert sorted(tuple(r) for r in again.collect()) == rows
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_names_share_a_column_and_markup_gives_way_to_text(spark):
    pages = spark.createDataFrame([("u", "<h1>a<i>b</i></h1><h2>c</h2>")], "url string, html string")
    rules = [Rule(0, "T", ("h1",), remove_tags=True), Rule(1, "T", ("h2",), collect_text=True, remove_tags=True)]
    assert [r["T"] for r in extract_table(shred_rules(pages, rules), rules).orderBy("row_ord").collect()] == ["a<i>b</i>", "c"]


def test_strided_slips_as_coded(spark):
    rules = RULES[:2]
    got = sorted(tuple(r) for r in extract_strided(shop(spark), rules).collect())
    assert got == [("u0", 0, "1", "2")]              # the name slips out of its column and is dropped


def test_lines(spark):
    got = {(r.url, r.name): r.line for r in extract_lines(shop(spark), RULES).collect()}
    assert got["u0", "Price"] == "1,2" and got["u0", "Name"] == '"A, ""x"""' and got["u3", "Name"] == ""
    assert len(got) == 16


def hot(spark):
    """One group holds two thirds of the rows; keys repeat."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(700)).alias("k"), F.col("id").alias("v"))


def test_rank_of_a_hot_group_is_spread(spark):
    rows = group_rank(hot(spark), ["g"], ["k", "v"]).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.g].append((r.k, r.v, r["rank"]))
    assert sum(map(len, groups.values())) == 3000
    for g in groups.values():
        assert [x[2] for x in sorted(g)] == list(range(len(g)))


def test_rank_plan_never_windows_a_whole_group(spark):
    plan = group_rank(hot(spark), ["g"], ["k", "v"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # One window runs inside a range partition, the other over one row per partition and group.
    assert any("_part" in w and "_amount" in w for w in windows) and any("_sum" in w for w in windows)
    assert len(windows) == 2


def test_running_total_with_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 2)], "g string, k int, n int")
    got = {(r.g, r.k): r.before for r in running_total(df, ["g"], ["k"], F.col("n")).collect()}
    assert got == {(None, 1): 0, (None, 2): 5, ("a", 1): 0}


def test_strided_and_horizontal_over_a_hot_scope(spark):
    values = hot(spark).select(F.col("g").alias("s"), "k", "v", F.col("v").cast("string").alias("value"))
    ordered = defaultdict(list)
    for r in values.collect():
        ordered[r.s].append((r.k, r.v, r.value))
    rows = {(r.s, r.row_id): (r.c0, r.c1, r.c2) for r in R.reshape_strided(values, 3, ["s"], ["k", "v"]).collect()}
    want = {}
    for s, items in ordered.items():
        flat = [x[2] for x in sorted(items)]
        for i in range(len(flat) // 3):
            want[s, i] = tuple(flat[3 * i:3 * i + 3])
    assert rows == want
    lines = R.layout_horizontal(values.withColumn("name", F.lit("n")), ["s"], ["k", "v"], line_values=100).collect()
    assert max(r.line.count(",") for r in lines) == 99
    whole = defaultdict(list)
    for r in sorted(lines, key=lambda r: r.part):
        whole[r.s].append(r.line)
    assert {s: ",".join(p) for s, p in whole.items()} == {s: ",".join(x[2] for x in sorted(i)) for s, i in ordered.items()}


@pytest.mark.parametrize("width", [1, 3, 40, 100_000])
def test_chunks_of_lists(spark, width):
    """Lists of 0 to 79 values, a hot scope, null lists and null values; one row per list is placed."""
    rng = random.Random(5)
    rows = [("hot" if k % 3 else f"s{k % 5}" if k % 4 else None, f"u{k:04d}",
             None if k % 17 == 0 else [None if rng.random() < 0.1 else f'{k},"{i}' for i in range(rng.choice([0, 1, 2, 79]))])
            for k in range(400)]
    lists = spark.createDataFrame(rows, "s string, url string, values array<string>").repartition(7)
    ws = Workspace(spark)
    have = {(r.s, r.chunk): list(r["items"]) for r in K.chunks_of(lists, ["s"], ["url"], "values", width, ws).collect()}
    want, flat = {}, defaultdict(list)
    for s, _, values in sorted(rows, key=lambda r: r[1]):
        flat[s] += values or []
    for s, values in flat.items():
        for at in range(0, len(values), width):
            want[s, at // width] = values[at:at + width]
    assert have == want
    assert spark.read.parquet(f"{ws.path}/ranges").count() == sum(bool(v) for _, _, v in rows)
    lines = K.horizontal_lists(lists, ["s"], ["url"], line_values=width).collect()
    assert len(lines) == len(want)
    full = {(r.s, r.row_id): r.c0 for r in K.strided_lists(lists, width, ["s"], ["url"]).select("s", "row_id", "c0").collect()} if width < 50 else {}
    assert full == ({k: v[0] for k, v in want.items() if len(v) == width} if width < 50 else {})
    assert K.chunks_of(lists.limit(0), ["s"], ["url"], "values", width).count() == 0


def test_schedule(spark):
    df = spark.createDataFrame([("http://a/2", None), ("http://a/1", None), ("http://b/1", 5.0), ("http://b/2", 5.0), ("http://b/3", 0.0)],
                               "url string, d double")
    got = {r.url: r.offset_s for r in crawl_schedule(df, 2.0, "d").collect()}
    assert got == {"http://a/1": 0.0, "http://a/2": 2.0, "http://b/1": 0.0, "http://b/2": 5.0, "http://b/3": 4.0}


def test_timeline_over_levels(spark):
    rows = [(0, "http://a/s", 0), (0, "http://a/1", 1), (0, "http://a/2", 1), (0, "http://a/3", 1), (0, "http://b/1", 1), (0, "http://b/2", 2),
            (0, "http://a/4", 2), (1, "http://a/9", 0), (1, "http://c/1", 1), (1, "http://c/2", 1)]
    found = spark.createDataFrame(rows, "seed_id int, url string, depth int")
    delays = spark.createDataFrame([(0, 2.0), (1, None)], "seed_id int, crawl_delay double")
    got = {(r.seed_id, r.url): (r.host, r.due) for r in crawl_timeline(found, delays).collect()}
    assert got == {(0, "http://a/s"): ("a", 0.0), (0, "http://a/1"): ("a", 2.0), (0, "http://a/2"): ("a", 4.0), (0, "http://a/3"): ("a", 6.0),
                   (0, "http://b/1"): ("b", 2.0), (0, "http://b/2"): ("b", 8.0), (0, "http://a/4"): ("a", 8.0),
                   (1, "http://a/9"): ("a", 0.0), (1, "http://c/1"): ("c", 0.0), (1, "http://c/2"): ("c", 0.0)}
    assert crawl_timeline(found.limit(0), delays).count() == 0


def test_registered_values(spark):
    register_value("size", lambda node, text: F.length(text))
    rules = [Rule(0, "P", ("p",), functions=("size",)), Rule(1, "A", ("a",), collect_text=True, attr_name="href", functions=("size",))]
    table = extract_table(shred_rules(spark.createDataFrame(SHOP, "url string, html string"), rules), rules)
    assert table.columns == ["url", "row_ord", "P size", "A", "A href", "A size"]
    assert sorted(tuple(r) for r in table.collect())[0] == ("u0", 1, "1", "t", "k", "1")
    bad = '{"elements":[{"name":"x","css_selector":"p","data_parsing":{"value_functions":["nobody"]}}]}'
    with pytest.raises(ValueError, match="nobody"):
        load_rules(spec_rules(parse_specs(spark.createDataFrame([(0, bad)], "spec_id int, spec string"))))


def test_stream_frontier_restarts_and_forgets(spark):
    from pagemill.plans import crawl as C
    ws = Workspace(spark)
    seeds = C.make_seeds(spark.createDataFrame([(0, "http://h/"), (1, "http://h/")], "seed_id int, url string"), url_patterns=["[a-d]$"])
    settings = C.attach_robots(seeds.withColumn("allowed_domains", F.when(F.col("seed_id") == 0, F.array(F.lit("h"), F.lit("g"))).otherwise(
        F.array(F.lit("h")))), None)
    visited = spark.createDataFrame([(0, "http://h/b")], "seed_id int, url string")
    schema = "url string, html string, at timestamp"

    def arrive(n, *rows):
        data = [(u, "".join(f'<a href="{h}">x</a>' for h in hrefs), t) for u, hrefs, t in rows]
        spark.createDataFrame(data, "url string, html string, t long").select(
            "url", "html", F.timestamp_seconds("t").alias("at")).coalesce(1).write.parquet(f"{ws.path}/in/{n}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{ws.path}/in")
        out = T.stream_frontier(stream, settings, "at", "1 hour", visited)
        query = T.stream_to_files(out.select("seed_id", "url"), f"{ws.path}/out", f"{ws.path}/state")
        query.awaitTermination()
        return query.lastProgress

    def got():
        return sorted(tuple(r) for r in spark.read.parquet(f"{ws.path}/out").collect())

    arrive(0, ("http://h/", ["/a", "/b", "/e", "//g/c", "/a"], 1), ("http://x/", ["http://h/d"], 1), ("HTTP://H/x", ["/a", "/d"], 5))
    run()
    first = [(0, "http://g/c"), (0, "http://h/a"), (0, "http://h/d"), (1, "http://h/a"), (1, "http://h/b"), (1, "http://h/d")]
    assert got() == first
    arrive(1, ("http://h/y", ["/a", "/c"], 10), ("http://h/z", ["/d"], 90_000))
    run()
    assert got() == sorted([*first, (0, "http://h/c"), (1, "http://h/c")])
    arrive(2, ("http://h/w", ["/c"], 180_000))
    arrive(3, ("http://h/w", ["/a"], 180_001))
    progress = run()                     # a day later everything older is forgotten
    assert sum(s["numRowsTotal"] for s in progress["stateOperators"]) <= 6
    assert got().count((0, "http://h/a")) == 2


def test_stream_frontier_takes_plain_targets_from_the_scan(spark):
    from pagemill.plans import crawl as C
    settings = C.attach_robots(C.make_seeds(spark.createDataFrame([(0, "http://h/")], "seed_id int, url string"), url_patterns=["a$"]), None)
    ws, schema = Workspace(spark), "url string, html string, at timestamp"
    ws.put(spark.createDataFrame([], schema), "in")
    stream = spark.readStream.schema(schema).parquet(f"{ws.path}/in")
    plan = T.stream_frontier(stream, settings, "at")._jdf.queryExecution().analyzed().toString()
    scan = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "targets#" in scan


def test_many_specs_at_once_agree_with_one_by_one(spark):
    ws = Workspace(spark)
    rows = [("http://h/", '<a href="/a">x</a><a href="/b">y</a>'), ("http://h/a", "<div class=w><p>1<p>2</div><h1>A</h1><a href=/b#f>z</a>"),
            ("http://h/b", "<h1>B</h1>"), ("http://g/", '<a href="c">x</a><h1>G</h1>'), ("http://g/c", "<div class=w><p>3</div><h1>C</h1>")]
    pages = spark.createDataFrame(rows, "url string, html string")
    heading = {"name": "H", "css_selector": "h1", "data_parsing": {"collect_text": True}}
    item = {"name": "P", "search_hierarchy": [{"css_selector": ".w"}, {"css_selector": "p"}], "data_parsing": {"collect_text": True, "remove_tags": True}}
    box = {"name": "W", "search_hierarchy": [{"css_selector": ".w"}], "data_parsing": {"remove_tags": True}}

    def spec(i, elements, *urls, sub=False):
        saving = {"csv": {"file_path": f"{ws.path}/out-{i}", "orientation": "vertical"}}
        return (i, json.dumps({"target_urls": [{"url": u, "options": {"only_scrape_sub_pages": sub}} for u in urls], "elements": elements,
                               "data_saving": saving if i != "quiet" else {}}))

    specs = [spec("one", [heading, item], "http://h/", sub=True), spec("two", [item, heading], "http://g/", "http://h/a"),
             spec("same", [heading, item], "http://g/"), spec("quiet", [box], "http://h/b", "http://g/")]
    done = run_jobs(spark, parse_specs(spark.createDataFrame(specs, "spec_id string, spec string")), pages)
    assert set(done.sinks) == {"one", "two", "same"}
    for name, text in specs:
        spark.createDataFrame([(text,)], "v string").coalesce(1).write.text(f"{ws.path}/spec-{name}")
        alone = run_job(spark, f"{ws.path}/spec-{name}", pages, write=False).table
        assert done.tables[name].columns == alone.columns
        want = sorted((tuple(r) for r in alone.collect()), key=str)
        assert sorted((tuple(r) for r in done.tables[name].collect()), key=str) == want
        assert want or name == "quiet"
        if name in done.sinks:
            assert S.read_csv(spark, {"file_path": f"{ws.path}/out-{name}"}, ", ".join(f"`{c}` STRING" for c in alone.columns[2:])).count() == len(want)


def test_specs_with_equal_seeds_share_a_crawl(spark, monkeypatch):
    from pagemill.plans import jobs
    rows = [("http://h/", '<h1>H</h1><a href="/a">x</a>'), ("http://h/a", '<h1>A</h1><p>p</p><a href="/#t">y</a>')]
    one, two = ({"name": n, "css_selector": n, "data_parsing": {"collect_text": True}} for n in ("h1", "p"))

    def spec(i, element, depth, *urls):
        targets = [{"url": u, "options": {"only_scrape_sub_pages": False}, "crawler": {"max_depth": depth, "allowed_domains": ["h"]}} for u in urls]
        return i, json.dumps({"target_urls": targets, "elements": [element]})

    specs = [spec("a", one, 6, "http://h/", "HTTP://H/"), spec("b", two, 6, "http://h/"), spec("c", one, 0, "http://h/")]
    seeds = []
    monkeypatch.setattr(jobs, "crawl", lambda given, *a, **k: (seeds.extend(r.seed_id for r in given.collect()), crawl(given, *a, **k))[1])
    crawl = C.crawl
    done = run_jobs(spark, parse_specs(spark.createDataFrame(specs, "spec_id string, spec string")), spark.createDataFrame(rows, "url string, html string"))
    assert sorted(seeds) == ["a 0", "c 0"]
    got = {i: sorted(tuple(r) for r in t.collect()) for i, t in done.tables.items()}
    assert got == {"a": [("http://h/", 1, "H"), ("http://h/#t", 1, "H"), ("http://h/a", 1, "A")], "b": [("http://h/a", 1, "p")], "c": [("http://h/", 1, "H")]}
    found = sorted((r.seed_id, r.url) for r in done.crawl.crawled.collect())
    assert found == [(i, u) for i in ("a 0", "a 1", "b 0") for u in ("http://h/", "http://h/#t", "http://h/a")] + [("c 0", "http://h/")]
    assert sorted(r.seed_id for r in done.crawl.seeds.collect()) == ["a 0", "a 1", "b 0", "c 0"]


def committed():
    """A local class travels with the plan."""
    class Staged(WriterCommitMessage):
        """Where a task left its rows."""

    class Committed(DataSource):
        """A sink in Python: rows are staged by the tasks and appear together when the write commits, once per batch number."""

        @classmethod
        def name(cls):
            return "committed"

        def writer(self, schema, overwrite):
            folder, number = self.options["path"], self.options.get("batch_id", "0")

            class Writer(DataSourceWriter):
                def write(self, rows):
                    from pyspark import TaskContext
                    staged = f"{folder}/staged-{number}-{TaskContext.get().taskAttemptId()}"
                    with open(staged, "w") as out:
                        for row in rows:
                            if "bad" in tuple(row):
                                raise ValueError("bad row")
                            out.write(json.dumps(list(row)) + "\n")
                    message = Staged()
                    message.path = staged
                    return message

                def commit(self, messages):
                    with open(f"{folder}/batch-{number}", "w") as out:
                        for staged in messages:
                            out.write(open(staged.path).read())

                def abort(self, messages):
                    open(f"{folder}/aborted-{number}", "w").close()

            return Writer()

    return Committed


def test_data_sources_are_sinks(spark, tmp_path):
    spark.dataSource.register(committed())
    saving = {"mine": {"format": "committed", "path": str(tmp_path)}, "nobody": {}}
    rows = spark.range(20).selectExpr("cast(id as string) AS a").repartition(3)
    assert S.write_all(rows, saving) == [("nobody", "unknown"), ("mine", "written")]
    back = [json.loads(x)[0] for x in (tmp_path / "batch-0").read_text().split()]
    assert sorted(back, key=int) == [str(i) for i in range(20)]
    with pytest.raises(Exception, match="bad row"):
        S.write_all(spark.createDataFrame([("bad",)], "a string"), {"mine": {**saving["mine"], "batch_id": "7"}})
    assert (tmp_path / "aborted-7").exists() and not (tmp_path / "batch-7").exists()


def test_stream_job_to_a_data_source(spark, tmp_path):
    spark.dataSource.register(committed())
    ws = Workspace(spark)
    spec = {"target_urls": [{"url": "http://h/"}], "elements": [{"name": "H", "css_selector": "h1", "data_parsing": {"collect_text": True}}],
            "data_saving": {"mine": {"format": "committed", "path": str(tmp_path)}}}
    spark.createDataFrame([(json.dumps(spec),)], "v string").coalesce(1).write.text(f"{ws.path}/spec")
    for n in range(2):
        spark.createDataFrame([(f"http://h/{n}", f"<h1>{n}</h1>")], "url string, html string").coalesce(1).write.parquet(f"{ws.path}/in/{n}")
        stream = spark.readStream.schema("url string, html string").option("recursiveFileLookup", "true").parquet(f"{ws.path}/in")
        T.stream_job(spark, f"{ws.path}/spec", stream, f"{ws.path}/state").awaitTermination()
        assert [json.loads(x) for x in (tmp_path / f"batch-{n}").read_text().split()] == [[str(n)]]
    assert sorted(p.name for p in tmp_path.glob("batch-*")) == ["batch-0", "batch-1"]


def test_responses(spark):
    pages = spark.createDataFrame([("a", "x", 200), ("b", "y", -1), ("c", "z", 404), ("e", "w", None)], "url string, html string, status int")
    fetched = fetch_pages(spark.createDataFrame([(u,) for u in "abcde"], "url string"), pages)
    assert sorted(r.url for r in response_gate(fetched).collect()) == ["a", "c", "e"]
    assert sorted(r.url for r in failed_fetches(fetched).collect()) == ["b", "d"]
    assert {(r.status, r.verdict) for r in status_report(fetched).collect()} >= {(-1, "bad"), (404, "good")}


def test_bodies_stay_where_they_are_read(spark):
    ws = Workspace(spark)
    rows = [(k, None if k % 50 == 1 else "hot" if k < 300 else f"u{k}", f"<p>{k}", k % 7) for k in range(400)] + [(500, "hot", "<p>299", 299 % 7)]
    stored = ws.put(spark.createDataFrame(rows, "page_id long, url string, html string, seen int").repartition(5), "pages")
    pages = stored.filter("page_id <> 3").withColumn("url", F.upper("url"))
    for arrival in ("page_id", "seen"):
        want = {}
        for i, u, h, n in rows:
            if i != 3:
                want.setdefault(u and u.upper(), []).append((i if arrival == "page_id" else n, h, i))
        got = latest_pages(pages, arrival)
        by_url = {r.url: (r[arrival], r.html) for r in got.collect()}
        assert got.count() == len(by_url) == len(want) and got.columns == pages.columns
        assert all(v[0] == max(w[0] for w in want[u]) and v in {w[:2] for w in want[u]} for u, v in by_url.items())
        plan = got._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange" in line]
        assert moved and all("Broadcast" in line for line in moved)
    narrow = P.outdated(P.located(pages), "page_id")._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in narrow.splitlines() if "Aggregate" in line or "Join" in line]
    assert aggregates and not any("html#" in line and "xxhash64" not in line for line in aggregates)


def test_latest_of_many_copies(spark):
    pages = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("url"),
                                     F.col("id").cast("string").alias("html"), F.col("id").alias("page_id"))
    got = {r.url: r.html for r in latest_pages(pages).collect()}
    assert len(got) == 101 and got["hot"] == "899"


def test_flagged_seeds_are_dropped(spark):
    pages = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    seeds = spark.createDataFrame([("a", True), ("b", False)], "url string, only_scrape_sub_pages boolean")
    assert sorted(r.url for r in drop_seed_pages(pages, seeds).collect()) == ["b", "c"]


def test_csv_keeps_every_value(spark, tmp_path):
    df = spark.createDataFrame([('a,"b"', None, " x "), ("l1\nl2\r\nl3", "", "\\")], "a string, b string, c string")
    options = {"file_path": str(tmp_path / "o"), "delimiter": ","}
    S.write_csv(df, options, "overwrite")
    S.write_csv(df, options)
    want = sorted([tuple(r) for r in df.collect()] * 2, key=str)
    assert sorted((tuple(r) for r in S.read_csv(spark, options, df.schema).collect()), key=str) == want
    for part in (tmp_path / "o").glob("*.csv"):
        with open(part, newline="") as f:
            assert next(csv.reader(f)) == ["a", "b", "c"]


def test_sink_errors_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("a\tb\n\\",)], "x string")
    with pytest.raises(ValueError):
        S.write_csv(df, {})
    with pytest.raises(ValueError):
        S.write_csv(df, {"file_path": "x", "orientation": "diagonal"})
    seen = []
    S.register_sink("memory", lambda d, o, mode: seen.append((d.count(), mode)))
    report = S.write_all(df, {"memory": {}, "txt": {"file_path": str(tmp_path / "t")}, "csv": {"enabled": False}, "fax": {}, "database": None})
    assert report == [("csv", "disabled"), ("fax", "unknown"), ("memory", "written"), ("txt", "written")]
    assert seen == [(1, "append")]
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a\\tb\\n\\\\"]
    del S.SINKS["memory"]


def test_database_options():
    keys = {"type": "mysql", "host": "localhost", "port": 3306, "username": "u", "password": "p", "database_name": "d"}
    assert S.jdbc_options(keys) == {"url": "jdbc:mysql://localhost:3306/d", "dbtable": "scraped_data", "batchsize": "10000",
                                    "user": "u", "password": "p"}
    with pytest.raises(ValueError, match="host"):
        S.jdbc_options({"type": "mysql", "port": 1, "database_name": "d"})


def write_job(tmp_path, orientation):
    doc = {"target_urls": [{"url": "http://h/", "options": {"only_scrape_sub_pages": True}}],
           "elements": [{"name": "Price", "css_selector": ".price", "data_parsing": {"collect_text": True}},
                        {"name": "Name", "css_selector": "h1", "data_parsing": {"collect_text": True}}],
           "data_saving": {"csv": {"file_path": str(tmp_path / "csv"), "orientation": orientation},
                           "txt": {"file_path": str(tmp_path / "txt")}},
           "data_order": ["Name"]}
    path = tmp_path / "spec.json"
    path.write_text(json.dumps(doc))
    return str(path)


def job_pages(spark):
    return spark.createDataFrame([
        ("http://h/", "<h1>index</h1><a href=1>x</a><a href=2>y</a><a href=3>gone</a>"), ("http://h/1", "<h1>one</h1><i class=price>5</i>"),
        ("http://h/2", "<h1>two</h1><i class=price>6</i><i class=price>7</i>"), ("http://h/9", "<h1>unreached</h1>")], "url string, html string")


def test_job(spark, tmp_path):
    hooks = []
    result = run_job(spark, write_job(tmp_path, "vertical"), job_pages(spark),
                     on_pages=lambda df: hooks.append("pages") or df, on_cells=lambda df: hooks.append("cells") or df)
    assert hooks == ["pages", "cells"] and result.problems.count() == 0
    assert result.sinks == [("csv", "written"), ("txt", "written")]
    want = [("one", "5"), ("two", "6"), (None, "7")]
    back = S.read_csv(spark, {"file_path": str(tmp_path / "csv")}, "Name string, Price string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(want, key=str)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "txt")).collect()) == ["\t7", "one\t5", "two\t6"]


def test_horizontal_job(spark, tmp_path):
    run_job(spark, write_job(tmp_path, "horizontal"), job_pages(spark))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "csv")).collect()) == [
        "Name,one", "Name,two", "Price,5", "Price,6,7"]
    run_job(spark, write_job(tmp_path, "horizontal"), job_pages(spark), on_cells=lambda df: df.withColumn("Price", F.concat("Price", F.lit("!"))))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "csv")).collect()) == [
        "Name,one", "Name,two", "Price,5!", "Price,6!,7!"]
    with pytest.raises(ValueError, match="orientation"):
        run_job(spark, write_job(tmp_path, "diagonal"), job_pages(spark))


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SHOP * 5)], "page_id bigint, url string, html string")
    pages.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = T.stream_pages(spark, str(tmp_path / "in"), files_per_batch=1)
    table = T.stream_extract(stream, RULES).toDF("page_id", "url", "r", "c0", "c1", "c2", "c3")
    T.stream_to_files(table, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted(map(tuple, extract_table(shred_rules(pages, RULES), RULES).collect()), key=str)
    # A second run finds nothing new.
    T.stream_to_files(table, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_stream_dedup_with_event_time(spark, tmp_path):
    rows = spark.sql("SELECT concat('u', id % 3) AS url, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id,0) AS seen FROM range(9)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    T.stream_to_files(T.stream_new_urls(stream, "seen", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u0", "u1", "u2"]


def test_elements_may_be_called_like_the_keys(spark, tmp_path):
    page = "<h1>T</h1><p class='u'>one</p><p class='u'>two</p><i>r</i>"
    spec = {"target_urls": [{"url": "HTTP://Host.test/", "options": {"only_scrape_sub_pages": False}}],
            "elements": [{"name": n, "css_selector": t, "data_parsing": {"collect_text": True}} for n, t in (("url", "p"), ("row_ord", "i"), ("H", "h1"))],
            "data_saving": {"csv": {"enabled": True, "file_path": str(tmp_path / "out")}}}
    (tmp_path / "spec").mkdir()
    (tmp_path / "spec" / "a.json").write_text(json.dumps(spec))
    copies = spark.createDataFrame([("http://host.test/", page), ("http://host.test/", page.replace("one", "three"))], "url string, html string")
    result = run_job(spark, str(tmp_path / "spec"), copies.withColumn("status", F.lit(200)))
    assert result.table.columns == ["url", "row_ord", "url", "row_ord", "H"]
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert len(rows) == 2 and {r[1] for r in rows} == {"r", None} and "two" in {r[0] for r in rows}
    (tmp_path / "spec" / "b.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="exactly one spec"):
        run_job(spark, str(tmp_path / "spec"), copies)


def test_job_moves_no_page_bodies(spark, tmp_path):
    from pagemill.plans.job import job_index
    index = job_index(job_pages(spark), RULES)
    plan = index._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Aggregate" in line or "Exchange" in line]
    assert plan.count("MapInArrow") == 1 and moved and not any("html" in line for line in moved)
    links = {r.url: r.targets for r in index.collect()}
    assert links["http://h/"] == ["http://h/1", "http://h/2", "http://h/3"] and links["http://h/9"] == []


def test_job_gives_the_same_rows_with_and_without_a_page_hook(spark, tmp_path):
    old = spark.createDataFrame([("http://h/1", "<h1>old</h1>", 0)], "url string, html string, day int")
    corpus = job_pages(spark).withColumn("day", F.lit(1)).union(old)
    spec = write_job(tmp_path, "vertical")
    plain, hooked = (run_job(spark, spec, corpus, arrival="day", on_pages=hook, write=False).table
                     for hook in (None, lambda df: df))
    want = [("http://h/1", 1, "one", "5"), ("http://h/2", 1, "two", "6"), ("http://h/2", 2, None, "7")]
    key = ["url", "row_ord"]
    assert [tuple(r) for r in plain.orderBy(*key).collect()] == [tuple(r) for r in hooked.orderBy(*key).collect()] == want


@pytest.fixture()
def pages_in_files(spark, tmp_path):
    """A folder whose pages table is a folder of three files."""
    rows = [(i, f"http://x.org/{i}", f'<title>t{i}</title><nav><a href="/{i}">l</a></nav><div class="ad">d</div>') for i in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3, "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_stream_cells_of_a_table_in_several_files(spark, pages_in_files):
    assert catalog.stream_cells(spark, pages_in_files).count() == 6 * 4
    assert catalog.stream_extract(spark, pages_in_files).count() == 6
    assert [r.url for r in catalog.stream_dedup(spark, pages_in_files).collect()] == ["x.org"]


def test_stream_job_of_a_table_in_several_files(spark, pages_in_files):
    assert catalog.stream_job(spark, pages_in_files).count() == 5


def test_streams_of_a_table_in_one_file(spark, tmp_path):
    ws = Workspace(spark)
    rows = [(i, f"http://x.org/{i}", f'<title>t{i}</title><nav><a href="/{i}">l</a></nav><div class="ad">d</div>') for i in range(3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{ws.path}/written")
    (tmp_path / "pages.parquet").write_bytes(next(Path(f"{ws.path}/written").glob("part-*")).read_bytes())
    assert catalog.stream_job(spark, str(tmp_path)).count() == 2
    assert [r.url for r in catalog.stream_dedup(spark, str(tmp_path)).collect()] == ["x.org"]


def test_stream_state_is_on_disk_and_settings_come_back(spark, tmp_path):
    pages = spark.createDataFrame([("http://h/a",), ("http://h/b",), ("http://h/a",)], "url string")
    pages.write.parquet(f"{tmp_path}/in")
    before = {k: spark.conf.get(k, None) for k in T.DISK_STATE}
    arriving = T.stream_pages(spark, f"{tmp_path}/in", schema="url STRING")
    query = T.stream_to_files(T.stream_new_urls(arriving), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert {k: spark.conf.get(k, None) for k in T.DISK_STATE} == before
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["http://h/a", "http://h/b"]
    assert any(name.startswith("rocksdb") for name in query.lastProgress["stateOperators"][0]["customMetrics"])
