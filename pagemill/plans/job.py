"""A whole job: spec and corpus in, crawled and extracted table out, written to the spec's sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..operators.extract import apply_rules, extract_table, output_columns, pages_and_links, shred_rules
from ..operators.reshape import table_lines, zipped_rows
from ..sinks.writers import check_csv, enabled, write_all
from ..sources.pages import latest_pages, response_gate
from ..sources.specs import Rule, load_rules, one_spec, rule_problems, saving_options, spec_rules, spec_seeds
from ..storage import Workspace
from .crawl import Crawl, answered_pages, candidate_pages, crawl, make_seeds, newest

Hook = Callable[[DataFrame], DataFrame]


@dataclass
class JobResult:
    table: DataFrame           # (url, row_ord, <elements in data order>)
    crawl: Crawl
    problems: DataFrame
    sinks: list[tuple[str, str]]


def run_job(spark: SparkSession, spec_path: str, pages: DataFrame, robots: DataFrame | None = None,
            redirects: DataFrame | None = None, arrival: str | None = None, on_pages: Hook | None = None,
            on_cells: Hook | None = None, write: bool = True, clear: bool = True) -> JobResult:
    """Run one spec over a corpus ``(url, html, status)``.

    The corpus holds one row per URL; where it holds copies, ``arrival`` names the column whose
    greatest value marks the response that counts, and ties go by a hash of the page. Crawl and
    extraction use the same copy. ``spec_path`` names exactly one spec. Elements may be called
    ``url`` or ``row_ord``: the two key columns always come first and are told apart by position.
    ``on_pages`` sees the reached pages before extraction and ``on_cells`` the wide table before
    it is written; both may change what they get. The table is computed once and written to every
    enabled sink.

    A page is parsed once, for its links and its rows, and no page body leaves the task that reads
    it. Only ``on_pages`` needs bodies of reached pages, so with it they are joined and parsed again.
    """
    spec = one_spec(spark, spec_path)
    saving = saving_options(spec)
    check_saving(saving)
    pages = pages.withColumn("url", normalize_url(F.col("url")))
    rules_df = spec_rules(spec)
    rules = load_rules(rules_df)
    ws = Workspace(spark)
    seeds = ws.put(make_seeds(spec_seeds(spec).drop("spec_id")), "seeds")
    if on_pages:
        result = crawl(seeds, pages, robots, redirects, arrival, track_source=False)
        answered = response_gate(pages if "status" in pages.columns else pages.withColumn("status", F.lit(200)))
        table = extract_table(shred_rules(
            on_pages(result.pages(latest_pages(answered, arrival, ws)).select("url", "html")), rules), rules)
    else:
        parsed = ws.put_bucketed(job_index(candidate_pages(pages, seeds, redirects), rules, arrival), "parsed", "url")
        result = crawl(seeds, pages, robots, redirects, track_source=False, index=parsed)
        flagged = result.seeds.filter("only_scrape_sub_pages").select("url")
        rows = result.answers.filter(F.size("rows") > 0).select("url", "rows").join(flagged, "url", "left_anti")
        table = zipped_rows(rows.dropDuplicates(["url"]), ["url"], "rows", output_columns(rules))
    if on_cells:
        table = on_cells(table)
    sinks: list[tuple[str, str]] = []
    if write and saving:
        table, sinks = save_table(table, saving, clear, ws)
    return JobResult(table, result, rule_problems(rules_df), sinks)


def job_index(pages: DataFrame, rules: list[Rule], arrival: str | None = None) -> DataFrame:
    """``(url, status, targets, rows)``: one row per answered page, what the crawl and the table need of it."""
    return newest(pages_and_links(answered_pages(pages, arrival), rules, "status", "_order"))


def check_saving(saving: dict[str, dict]) -> None:
    """Errors in the options come before the work, not after it."""
    if "csv" in saving and enabled(saving["csv"]):
        check_csv(saving["csv"])


def save_table(table: DataFrame, saving: dict[str, dict], clear: bool, ws: Workspace) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Write ``(url, row_ord, <elements>)`` to every sink of a spec; the stored table and the outcomes.

    Every layout comes from the one stored table, so a hook on it counts in all of them.
    """
    columns = table.columns
    # Column names from a spec may hold characters that a columnar file does not take.
    stored = ws.put(table.toDF(*[f"c{i}" for i in range(len(columns))]), "table")
    # Keys go by position: elements may have their names.
    keyed = columns[:2] == ["url", "row_ord"]
    names = {f"c{i}": n for i, n in enumerate(columns) if i >= 2 or not keyed}
    saving, sinks = dict(saving), []
    if saving.get("csv", {}).get("orientation") == "horizontal":
        if not keyed:
            raise ValueError("horizontal output needs url and row_ord as the first columns")
        csv = saving.pop("csv")
        sinks += write_all(table_lines(stored, "c0", "c1", names, csv.get("delimiter") or ","), {"csv": csv}, clear, ws)
    sinks += write_all(stored.select(*names).toDF(*names.values()), saving, clear, ws)
    return stored.toDF(*columns), sinks


def job_cells(pages: DataFrame, rules_df: DataFrame) -> DataFrame:
    """Long form of the extraction, one row per value."""
    rules = load_rules(rules_df)
    return apply_rules(shred_rules(pages, rules), rules)
