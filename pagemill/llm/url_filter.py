"""URL rules found by short hash prefixes of host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import boxed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query: verdict, then host and path prefix.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]
#: Hexadecimal digits of a digest's short prefix.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_table(rules: DataFrame) -> DataFrame:
    """``rules (verdict, rule)`` with host, path length and digest. A rule is its host, then a path
    prefix from the first ``/``; a rule without ``/`` covers its host whatever the path. Rules that
    repeat count once; of two verdicts for one rule, block holds. Null rules are none."""
    known = rules.filter("rule IS NOT NULL AND verdict IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    return known.select("rule", "verdict", F.sha2("rule", 256).alias("digest")).withColumn(
        "short", F.substring("digest", 1, SHORT))


def judge_urls(pages: DataFrame, rules: DataFrame, ws: Workspace, url: str = "url",
               default: str = "allow") -> DataFrame:
    """``(row, host, path, rule, verdict)`` for every row of ``pages``.

    A rule fits its host and all subdomains, for paths that start with the rule's; the longest
    rule wins. Without a fitting rule the verdict is ``default`` and ``rule`` is null.

    A null URL and one without ``://`` have an empty host and path, which no rule fits. Repeated
    URLs are judged once. Very long URLs and hosts are expanded whole: one expression per label of
    the host and path length that occurs among the rules. An empty table gives an empty one; no
    rules give the default everywhere.

    Distinct pairs of host and path (cut at the longest path of a rule) are expanded, so a hot host
    or page is few rows before the join, and verdicts come back to the pages by that pair, in a
    join that adaptive execution may split. Lengths of rule paths are the one thing the driver
    sees: at most as many numbers as the longest rule has characters.
    """
    own = boxed(pages, url=url)
    host, path = host_and_path(F.col("url"))
    parted = own.select("row", host.alias("host"), path.alias("path"))
    table = ws.put(rule_table(rules), "rules")
    slash = F.locate("/", F.col("rule"))
    of_path = F.when(slash > 0, F.length("rule") - slash + 1).otherwise(0)
    lengths = sorted(r[0] for r in table.select(of_path.alias("n")).distinct().toLocalIterator())
    cut = F.substring("path", 1, max(lengths, default=0))
    pairs = parted.select("host", cut.alias("start")).filter("host <> ''").distinct()

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("start") >= n, F.substring("start", 1, n)) for n in lengths]),
                        lambda p: p.isNotNull())
    spread = (pairs.select("host", "start", F.explode(suffixes).alias("suffix"))
              .select("host", "start", F.explode(F.transform(prefixes, lambda p: F.concat("suffix", p))).alias("expr"))
              if lengths else pairs.select("host", "start", F.lit("").alias("expr")).filter(F.lit(False)))
    hashed = spread.select("host", "start", F.sha2("expr", 256).alias("own")).withColumn(
        "short", F.substring("own", 1, SHORT))
    fits = hashed.join(table, "short").filter("own = digest")
    best = fits.groupBy("host", "start").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    best = ws.put(best.select(F.col("host").alias("h"), F.col("start").alias("s"), "best.rule", "best.verdict"), "best")
    met = parted.join(best, (F.col("host") == F.col("h")) & (cut == F.col("s")), "left")
    return met.select("row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op4(spark, folder: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    return judge_urls(pages, rules, Workspace(spark)).select("row.page_id", "host", "path", "rule", "verdict")


SQL = rf"""WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rule, h, p) AS (VALUES {", ".join(
    f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
fits AS (SELECT u.page_id, u.host, u.path, arg_max(r.rule, length(r.rule)) AS rule,
                arg_max(r.verdict, length(r.rule)) AS verdict
         FROM (SELECT DISTINCT * FROM urls) u JOIN rules r
           ON (u.host = r.h OR suffix(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
         GROUP BY ALL)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id AND u.host = f.host AND u.path = f.path"""
