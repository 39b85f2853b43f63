"""Many specs in one run: one crawl, one parse of each page, one table and one set of sinks per spec."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_url, page_url, url_domain
from ..operators.extract import output_columns, pages_for_sets
from ..operators.lookup import spread_lookup
from ..sources.specs import load_rule_sets, saving_by_spec, spec_rules, spec_seeds
from ..storage import Workspace
from .crawl import Crawl, answered_pages, candidate_pages, crawl, make_seeds, newest
from .job import check_saving, save_table


@dataclass
class JobsResult:
    tables: dict[str, DataFrame]                  # per spec: (url, row_ord, <elements in data order>)
    crawl: Crawl                                  # ``seed_id`` is "<spec_id> <seed_id>"
    sinks: dict[str, list[tuple[str, str]]]


def wanted_pages(pages: DataFrame, seeds: DataFrame, redirects: DataFrame | None, sets: list[int]) -> DataFrame:
    """Candidate pages with ``sets``: the rule sets of the specs that allow the page's domain. A page that
    some seed or redirect names may be wanted by any spec of theirs, so it gets all ``sets``."""
    by_domain = seeds.select("set_no", F.explode("allowed_domains").alias("_domain")).groupBy("_domain").agg(
        F.collect_set("set_no").alias("_sets"))
    named = seeds.select("url")
    if redirects is not None:
        named = named.union(redirects.select(normalize_url(F.col("dst_url"))))
    named = named.union(named.select(page_url(F.col("url")))).distinct().withColumn("_named", F.lit(True))
    placed = candidate_pages(pages, seeds, redirects).withColumn("_domain", url_domain(F.col("url")))
    known = spread_lookup(placed, by_domain, "_domain", "url").join(named, "url", "left")
    wanted = F.when(F.col("_named"), F.array(*[F.lit(n) for n in sets])).otherwise(F.col("_sets"))
    return known.select(*pages.columns, wanted.alias("sets"))


def with_leaders(seeds: DataFrame) -> DataFrame:
    """Add ``leader``: the first of the seeds that have the same URL and settings, which reach the same pages."""
    same = Window.partitionBy(*[c for c in seeds.columns if c != "seed_id"])
    return seeds.withColumn("leader", F.min("seed_id").over(same))


def for_members(result: Crawl, members: DataFrame) -> Crawl:
    """The crawl of the leaders as that of all seeds. ``members`` are ``(seed_id, _leader)``."""
    def each(table: DataFrame) -> DataFrame:
        led = table.withColumnRenamed("seed_id", "_leader").join(members, "_leader")
        return led.select(*table.columns)

    return Crawl(each(result.found), result.index, each(result.seeds))


def run_jobs(spark: SparkSession, specs: DataFrame, pages: DataFrame, robots: DataFrame | None = None,
             redirects: DataFrame | None = None, arrival: str | None = None, write: bool = True,
             clear: bool = True) -> JobsResult:
    """Run all specs of a table (``specs.read_spec`` or ``specs.parse_specs``) over one corpus ``(url, html, status)``.

    All seeds advance together in one crawl, those with the same URL and settings as one. A page is parsed once; the rules are data: specs with equal
    rules share a set, a set is only tried on pages that one of its specs may reach, and the first
    steps that search hierarchies of any specs have in common are walked once per page. A spec gets
    the rows of the pages that its own seeds reached, and its own sinks. Specs are documents that someone
    wrote, so their number is small next to the pages; the driver compiles them into one plan.
    """
    ws = Workspace(spark)
    saving = saving_by_spec(specs)
    for options in saving.values():
        check_saving(options)
    sets, set_of = load_rule_sets(spec_rules(specs))
    numbers = spark.createDataFrame([(s, i, set_of[s]) for i, s in enumerate(sorted(set_of))], "spec_id string, spec_no int, set_no int")
    own = spec_seeds(specs).withColumn("spec_id", F.col("spec_id").cast("string")).join(numbers, "spec_id")
    keyed = own.withColumn("seed_id", F.concat_ws(" ", "spec_id", "seed_id"))
    owners = ws.put(keyed.select("seed_id", "spec_no", "set_no", "url", "allowed_domains", "only_scrape_sub_pages"), "owners")
    seeds = ws.put(make_seeds(keyed.drop("spec_id", "spec_no", "set_no")), "seeds")
    pages = pages.withColumn("url", normalize_url(F.col("url")))
    answered = answered_pages(wanted_pages(pages, owners, redirects, list(sets)), arrival, keep=("sets",))
    parsed = ws.put_bucketed(newest(pages_for_sets(answered, sets, "status", "_order")), "parsed", "url")
    led = ws.put(with_leaders(seeds.distinct()), "led")
    leaders = led.filter(F.col("seed_id") == F.col("leader")).drop("leader")
    result = crawl(leaders, pages, robots, redirects, track_source=False, index=parsed)
    members = led.select("seed_id", F.col("leader").alias("_leader"))
    flagged = owners.filter("only_scrape_sub_pages").select("spec_no", "url")
    owned = owners.join(members, "seed_id").select(F.col("_leader").alias("seed_id"), "spec_no", "set_no").distinct()
    rows = F.get(F.filter("found", lambda f: f["set_no"] == F.col("set_no")), F.lit(0))["rows"]
    reached = result.answers.select("seed_id", "url", "found").join(owned, "seed_id").select("spec_no", "url", rows.alias("rows"))
    met = (reached.filter(F.size("rows") > 0).join(flagged, ["spec_no", "url"], "left_anti")
           .dropDuplicates(["spec_no", "url"]))
    long = met.select("spec_no", "url", F.posexplode("rows").alias("row_ord", "row")).withColumn("row_ord", F.col("row_ord") + 1)
    long.repartition("spec_no", "url").write.partitionBy("spec_no").parquet(f"{ws.path}/rows")
    stored = spark.read.schema("url string, row_ord int, row array<string>, spec_no int").parquet(f"{ws.path}/rows")
    tables, sinks = {}, {}
    for spec_id, number in sorted((s, i) for i, s in enumerate(sorted(set_of))):
        names = output_columns(sets[set_of[spec_id]])
        table = stored.filter(F.col("spec_no") == number).select(
            "url", "row_ord", *[F.get("row", F.lit(i)).alias(n) for i, n in enumerate(names)])
        if write and saving.get(spec_id):
            table, sinks[spec_id] = save_table(table, saving[spec_id], clear, Workspace(spark))
        tables[spec_id] = table
    return JobsResult(tables, for_members(result, members), sinks)
