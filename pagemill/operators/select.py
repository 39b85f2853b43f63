"""Selection over shredded pages; ``inside.join_inside`` does the same by joins over a stored node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.selectors import Page, css_positions, parse_selector, path_positions
from ..functions.values import collect_text

SHREDDED = ("chunks", "nodes")


def page_keys(shredded: DataFrame) -> list[str]:
    return [c for c in shredded.columns if c not in (*SHREDDED, "html")]


def _nodes_at(positions: Column, nodes: Column) -> Column:
    return F.transform(positions, lambda i: F.get(nodes, i))


def _rows(shredded: DataFrame, positions: Column) -> DataFrame:
    keys = page_keys(shredded)
    return (shredded.select(*keys, "chunks", F.posexplode(_nodes_at(positions, F.col("nodes"))).alias(
        "match_ord", "node")).withColumn("match_ord", F.col("match_ord") + 1))


def select_css(shredded: DataFrame, selector: str) -> DataFrame:
    """``(keys, chunks, match_ord, node)``: matches in document order, each once."""
    return _rows(shredded, css_positions(F.col("nodes"), selector))


def select_path(shredded: DataFrame, steps: list[str], distinct: bool = False) -> DataFrame:
    """``(keys, chunks, match_ord, node)``: step-wise narrowing, bag semantics in walk order."""
    return _rows(shredded, path_positions(F.col("nodes"), steps, distinct))


def with_text(matches: DataFrame) -> DataFrame:
    """Replace chunks and node by position, tag and text."""
    keys = [c for c in matches.columns if c not in ("chunks", "node")]
    return matches.select(*keys, F.col("node.pre").alias("pre"), F.col("node.tag").alias("tag"),
                          collect_text(F.col("node"), F.col("chunks")).alias("text"))


def node_filter(nodes: DataFrame, selector: str) -> DataFrame:
    """Rows of a node table that pass a selector without combinators (pushed to a columnar scan)."""
    parsed = parse_selector(selector)
    if not parsed.alone:
        raise ValueError("a node table is filtered by a node's own fields; join_inside adds the nesting")
    row = F.struct(*nodes.columns)
    return nodes.filter(parsed.holds(row, Page(F.array(row))))
