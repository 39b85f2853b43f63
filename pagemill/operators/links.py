"""Links of shredded pages: hrefs, click anchors, child URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dom import page_hrefs
from ..functions.expr import let
from ..functions.urls import base_parts, resolve_link, resolve_parts

# Hrefs that are clicked in a browser instead of being followed.
CLICK_HREFS = ("#", "javascript:void(0);", "javascript:;")


def anchor_hrefs(nodes: Column) -> Column:
    """href (or null) of every ``a`` in document order."""
    return F.transform(F.filter(nodes, lambda n: n["tag"] == "a"),
                       lambda n: F.element_at(n["attrs"], F.lit("href")))


def is_click(href: Column) -> Column:
    return F.coalesce(href, F.lit("")).isin(*CLICK_HREFS)


def extract_links(pages: DataFrame, *keys: str) -> DataFrame:
    """``(keys, url, ord, href)``: every anchor of every page, ``ord`` counting from 1."""
    found = page_hrefs(pages.select(*keys, "url", "html"))
    return found.select(*keys, "url", F.posexplode("hrefs").alias("ord", "href")).withColumn("ord", F.col("ord") + 1)


def skip_click_hrefs(links: DataFrame) -> DataFrame:
    """Links to follow; an anchor without href stays and later resolves to ``""``."""
    return links.filter(~is_click(F.col("href")))


def click_candidates(links: DataFrame) -> DataFrame:
    """Anchors that need a click."""
    return links.filter(is_click(F.col("href")))


def unprocessed_clicks(candidates: DataFrame, processed: DataFrame) -> DataFrame:
    """Click anchors on pages none of whose anchors was clicked before (by page URL)."""
    return candidates.join(processed.select("url"), "url", "left_anti")


def resolve_links(links: DataFrame) -> DataFrame:
    """Add ``dst_url``, resolved against the page's own URL."""
    return links.withColumn("dst_url", resolve_link(F.col("url"), F.col("href")))


def link_targets(hrefs: Column, url: Column) -> Column:
    """Distinct absolute targets of a page in first-seen order (``array<string>``)."""
    followed = F.filter(hrefs, lambda h: ~is_click(h) & (F.coalesce(h, F.lit("")) != ""))
    return F.array_distinct(let(base_parts(url), lambda base: F.transform(
        followed, lambda h: resolve_parts(base, h))))


def page_targets(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``targets``, those of :func:`link_targets`. Pages whose hrefs are all plain leave the Arrow
    stage with them; of the others the hrefs come back and are resolved by Spark's expressions."""
    found = page_hrefs(pages, skipped=CLICK_HREFS)
    return found.select(*[f"`{c}`" for c in pages.columns if c != "html"], scanned_targets().alias("targets"))


def scanned_targets() -> Column:
    """Targets of a page that left the Arrow stage with ``targets`` or, where these are null, with ``hrefs``."""
    return F.coalesce(F.array_distinct("targets"), link_targets(F.col("hrefs"), F.col("url")))
