"""Robots groups and decisions against the standard library's parser."""

import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from pagemill.storage import Workspace
from pagemill.sources.robots import (
    agent_group, filter_robots, read_robots, rule_table, rules_allow, with_robots, with_rule_table)

LINES = ["User-agent: *", "User-agent: Bot", "user-agent : other/1.0 # c", "Disallow: /a", "Allow: /a/b", "Disallow:", "DISALLOW: /a%20x?y=1",
         "Crawl-delay: 3", "Crawl-delay: x", "", "", "# note", "   ", "Sitemap: http://x/s", "Allow: /", "Disallow: *", "Request-rate: 1/5",
         "nonsense", "Disallow: /ü", "Disallow: /a;p", "User-agent: ", "Disallow: http://h/a"]
URLS = ["http://h/", "http://h", "http://h/a", "http://h/a/b/c", "http://h/a x?y=1&z", "http://h/a%20x?y=1", "http://h/%C3%BC", "http://h/b#f",
        "http://h/a;p;q", "http://h/*"]
AGENTS = ["*", "Bot", "otherbot/2.0", "nobody"]


def test_against_the_standard_library(spark):
    rng = random.Random(5)
    bodies = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    files = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "host string, body string")
    cases = spark.createDataFrame([(u, a) for u in URLS for a in AGENTS], "url string, agent string")
    got = (read_robots(files).crossJoin(cases).withColumn("g", agent_group(F.col("groups"), F.col("agent")))
           .select("host", "url", "agent", rules_allow(F.col("url"), F.col("g.rules")).alias("ok"), F.col("g.delay").alias("delay")))
    parsers = []
    for b in bodies:
        p = RobotFileParser()
        p.parse(b.splitlines())
        parsers.append(p)
    for r in got.collect():
        p = parsers[int(r.host)]
        assert r.ok == p.can_fetch(r.agent, r.url), (bodies[int(r.host)], r)
        assert r.delay == p.crawl_delay(r.agent), (bodies[int(r.host)], r)


def test_first_rule_wins_and_missing_files_allow(spark):
    body = "User-agent: *\nAllow: /customer/10\nDisallow: /customer/1\nCrawl-delay: 2\n"
    swapped = "User-agent: *\nDisallow: /customer/1\nAllow: /customer/10\n"
    files = spark.createDataFrame([("a", body, 200), ("b", swapped, 200), ("c", "", 403)], "host string, body string, status int")
    urls = spark.createDataFrame([(f"https://{h}/customer/{n}",) for h in "abcd" for n in (1, 10, 105, 11, 2)], "url string")
    kept = sorted(r.url for r in filter_robots(urls, read_robots(files)).collect())
    assert kept == sorted([f"https://a/customer/{n}" for n in (10, 105, 2)] + ["https://b/customer/2"] + [
        f"https://d/customer/{n}" for n in (1, 10, 105, 11, 2)])
    assert filter_robots(urls, read_robots(files), ignore=True).count() == 20


def test_hot_host_is_spread(spark):
    """Nine of ten URLs are on one host; no task gets them all, also where nothing is broadcast."""
    urls = spark.range(0, 100000, 1, 8).select(F.concat(
        F.lit("https://h"), F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 97).cast("string"), F.lit("/p/"),
        F.col("id").cast("string")).alias("url"))
    files = spark.range(97).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.lit(
        "User-agent: *\nDisallow: /p/1\n").alias("body"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        kept = filter_robots(urls, read_robots(files)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    total = sum(not str(i).startswith("1") for i in range(100000))
    assert sum(r["count"] for r in kept) == total
    assert max(r["count"] for r in kept) < 0.45 * total


def test_rule_table_agrees_with_lists(spark):
    rng = random.Random(6)
    paths = ["", "/", "/a", "/a/", "/ab", "/a/b", "/a/b?c", "/b%20c", "/é", "/long" * 9]

    def body():
        lines = [f"{rng.choice(['Allow', 'Disallow'])}: {rng.choice(paths)}" for _ in range(rng.randint(0, 9))]
        return "\n".join(["User-agent: *", *lines, "Crawl-delay: 3"][:rng.choice([1, 20, 20, 20])])

    files = [(f"h{k}", body(), 403 if k == 7 else 200) for k in range(25)] + [("h3", "zz", 200)]
    robots = read_robots(spark.createDataFrame(files, "host string, body string, status int"))
    urls = [(n, f"http://h{rng.randrange(28)}{rng.choice(paths)}{rng.choice(['', 'x', '/y', '?q', '#f'])}") for n in range(1500)]
    frame = spark.createDataFrame([*urls, (0, None), (1, "no url"), urls[5]], "n int, url string")
    want = sorted((tuple(r) for r in with_robots(frame, robots).collect()), key=str)
    got = with_rule_table(frame, *rule_table(robots))
    assert got.columns == with_robots(frame, robots).columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {r[2] for r in want} == {True, False}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_repeated_rules_are_not_broadcast(spark):
    """Stored rules look small to Spark, as it measures their file before they are repeated."""
    ws = Workspace(spark)
    lines = "User-agent: *\n" + "\n".join(f"Disallow: /{i}x" for i in range(200))
    files = spark.createDataFrame([("x.org", lines)], "host string, body string")
    rules, hosts = rule_table(ws.put(read_robots(files), "robots"))
    urls = spark.createDataFrame([("http://x.org/7x/a",), ("http://x.org/7",), ("http://y.org/7x",)], "url string")
    out = with_rule_table(urls, ws.put(rules, "rules"), ws.put(hosts, "hosts"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {r.url for r in out.collect() if not r.robots_ok} == {"http://x.org/7x/a"}
    assert "_salt" in plan and not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_salt" in line]
