"""Page tables: scan, one response per URL, fetch as a join, response gate, status report."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import page_url
from ..storage import Workspace

BAD_STATUS = -1        # fixed value: the status of a response that never came


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages as ``(page_id?, url, html, status)``; a corpus without status counts as fetched (200)."""
    return with_status(spark.read.format(fmt).load(path))


def with_status(pages: DataFrame) -> DataFrame:
    status = F.col("status").cast("int") if "status" in pages.columns else F.lit(200)
    keys = [c for c in ("page_id",) if c in pages.columns]
    return pages.select(*keys, "url", "html", status.alias("status"))


def arrival_order(arrival: str | None) -> Column:
    """What decides between copies of a page: the arrival, then a hash of the source."""
    return F.struct(*([F.col(arrival)] if arrival else []), F.xxhash64("html"))


def located(pages: DataFrame) -> DataFrame | None:
    """Pages with the place of each row in its file, ``_file`` and ``_row``; None where rows have no such place.

    Rows of a parquet scan have one, also after filters and new columns, but not after joins or aggregations.
    """
    try:
        return pages.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:
        return None


def outdated(placed: DataFrame, arrival: str | None) -> DataFrame:
    """``(_file, _row)`` of the copies that :func:`latest_pages` leaves out. Only narrow columns move."""
    narrow = placed.select("url", arrival_order(arrival).alias("_order"), "_file", "_row")
    copied = (narrow.groupBy("url").agg(F.max_by(F.struct("_file", "_row"), "_order").alias("_best"), F.count(F.lit(1)).alias("_n"))
              .filter("_n > 1").select(F.col("url").alias("_url"), "_best"))
    same = F.col("url").eqNullSafe(F.col("_url"))
    return narrow.join(copied, same).filter(F.struct("_file", "_row") != F.col("_best")).select("_file", "_row")


def latest_pages(pages: DataFrame, arrival: str | None = "page_id", workspace: Workspace | None = None) -> DataFrame:
    """One response per URL, the last arrival wins, :func:`arrival_order` breaks ties.

    Copies are told apart by their place in the files they were read from: URLs, orders and places
    are compared first, and a stored list of the outdated copies is all that meets the bodies. Bodies
    stay where they are read as long as Spark measures that list as small enough to broadcast.
    Rows without a place (:func:`located`) are combined by ``max_by`` on the map side, bodies included.
    Either way a URL that holds a large share of all rows sends one row per task into the shuffle.
    """
    placed = located(pages)
    if placed is None:
        rest = [c for c in pages.columns if c != "url"]
        best = F.max_by(F.struct(*rest), arrival_order(arrival)).alias("best")
        return pages.groupBy("url").agg(best).select("url", "best.*").select(*pages.columns)
    ws = workspace or Workspace(pages.sparkSession)
    return placed.join(ws.put(outdated(placed, arrival), "outdated"), ["_file", "_row"], "left_anti").select(*pages.columns)


def marked_urls(pages: DataFrame) -> DataFrame:
    """URLs that a corpus lists with a fragment, usually few or none."""
    return pages.select("url").filter(F.contains("url", F.lit("#"))).distinct()


def with_page(rows: DataFrame, marked: DataFrame, out: str = "page") -> DataFrame:
    """Add the URL under which the corpus has a page: a fragment is not asked for, unless the corpus
    itself lists the page with it (``marked``, from :func:`marked_urls`)."""
    known = marked.select(F.col("url").alias("_marked"))
    return (rows.join(known, F.col("url") == F.col("_marked"), "left")
            .withColumn(out, F.coalesce("_marked", page_url(F.col("url")))).drop("_marked"))


def _looked_up(frontier: DataFrame, pages: DataFrame, answers: DataFrame) -> DataFrame:
    placed = with_page(frontier, marked_urls(pages), "_page")
    return placed.join(answers.withColumnRenamed("url", "_page"), "_page", "left").drop("_page")


def fetch_pages(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Responses for a set of URLs: the corpus takes the place of the network.

    ``pages`` holds one row per URL. URLs that are not in the corpus keep null html. A URL with a
    fragment gets the response of its page.
    """
    return _looked_up(frontier, pages, pages.select("url", "html", "status"))


def fetch_outcomes(frontier: DataFrame, pages: DataFrame, bad_status: int = BAD_STATUS) -> DataFrame:
    """:func:`fetch_pages` without the bodies: status, and whether there was an answer.

    Bodies are looked at where they lie; only a flag goes through the join.
    """
    return _looked_up(frontier, pages, pages.select("url", "status", _answered(bad_status).alias("answered")))


def response_gate(fetched: DataFrame, bad_status: int = BAD_STATUS) -> DataFrame:
    """Keep answered requests. Other error statuses pass, as their bodies are scraped too."""
    return fetched.filter(_answered(bad_status))


def failed_fetches(fetched: DataFrame, bad_status: int = BAD_STATUS) -> DataFrame:
    """The complement of :func:`response_gate`: never answered or answered with the bad status.

    ``fetched`` is from :func:`fetch_pages` or, narrow, from :func:`fetch_outcomes`.
    """
    answered = F.col("answered") if "answered" in fetched.columns else _answered(bad_status)
    return fetched.filter(~F.coalesce(answered, F.lit(False)))


def _answered(bad_status: int):
    return F.col("html").isNotNull() & (F.coalesce(F.col("status"), F.lit(200)) != bad_status)


def status_report(fetched: DataFrame, bad_status: int = BAD_STATUS) -> DataFrame:
    """Responses per status with the verdict that is logged for each."""
    return fetched.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "verdict", F.when(F.col("status") == bad_status, "bad").otherwise("good"))
