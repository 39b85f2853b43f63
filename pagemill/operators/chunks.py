"""Long sequences of values cut into pieces of equal length, from one row per page.

Each row brings a list, such as a page's values of one element. Where a list stands in its whole
sequence follows from the sizes of the lists before it, so only list sizes are summed up and values
are never ranked one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import csv_field
from ..storage import Workspace
from .ranks import running_total

#: Values in one part of a horizontal line unless the caller says otherwise.
PART_VALUES = 100_000


def chunks_of(lists: DataFrame, scope: list[str], order: list[str], values: str, width: int,
              workspace: Workspace | None = None) -> DataFrame:
    """``(scope, chunk, items)``: the lists of a scope end to end, in ``order``, cut every ``width`` values.

    One row per list goes through the range shuffle. Chunks that lie within one list are cut out
    where the list is; only the first and last values of a list, fewer than ``2 * width``, are put
    together with those of its neighbours. ``width`` bounds what a task gathers for a chunk. The last
    chunk of a scope may be shorter. Empty and null lists count as no values; values may be null.
    """
    ws = workspace or Workspace(lists.sparkSession)
    named = {c: f"_s{i}" for i, c in enumerate(scope)}
    ordered = {c: f"_o{i}" for i, c in enumerate(order)}
    sized = lists.select(*[F.col(c).alias(n) for c, n in named.items()], *[F.col(c).alias(n) for c, n in ordered.items()],
                         F.col(values).alias("_v")).withColumn("_n", F.size("_v")).filter(F.col("_n") > 0)
    # The lists are written before the ranges are chosen, which looks at the rows twice: what made them runs once.
    stored = ws.put(sized, "lists")
    groups = list(named.values())
    placed = running_total(stored, groups, list(ordered.values()), F.col("_n"), "_before", ws)
    first, last = F.floor(F.col("_before") / width), F.floor((F.col("_before") + F.col("_n") - 1) / width)

    def piece(c: Column) -> Column:
        begin = F.greatest(c * width - F.col("_before"), F.lit(0)).cast("int")
        stop = F.least((c + 1) * width - F.col("_before"), F.col("_n")).cast("int")
        return F.struct(c.alias("chunk"), (F.col("_before") + begin - c * width).cast("int").alias("at"),
                        F.slice("_v", begin + 1, stop - begin).alias("items"))

    pieces = placed.select(*groups, F.inline(F.transform(F.sequence(first, last), piece)))
    whole = pieces.filter(F.size("items") == width).select(*groups, "chunk", "items")
    joined = (pieces.filter(F.size("items") < width).groupBy(*groups, "chunk")
              .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "items"))), lambda p: p["items"])).alias("items")))
    return whole.unionByName(joined).select(*[F.col(n).alias(c) for c, n in named.items()], "chunk", "items")


def strided_lists(lists: DataFrame, width: int, scope: list[str], order: list[str], values: str = "values",
                  workspace: Workspace | None = None) -> DataFrame:
    """``(scope, row_id, c0, c1, ...)``: literal positional assembly over a scope of any size.

    Value i of a scope goes to column i mod ``width`` of row i div ``width``; an incomplete last row
    is dropped.
    """
    rows = chunks_of(lists, scope, order, values, width, workspace).filter(F.size("items") == width)
    return rows.select(*scope, F.col("chunk").alias("row_id"), *[F.get("items", F.lit(i)).alias(f"c{i}") for i in range(width)])


def horizontal_lists(lists: DataFrame, scope: list[str], order: list[str], values: str = "values",
                     line_values: int = PART_VALUES, delimiter: str = ",", workspace: Workspace | None = None) -> DataFrame:
    """``(scope, part, line)``: the values of a scope across, in parts of ``line_values`` values.

    The parts in order, with the delimiter between them, give the whole line; a line of up to
    ``line_values`` values is part 0. ``scope`` names the element too.
    """
    parts = chunks_of(lists, scope, order, values, line_values, workspace)
    line = F.array_join(F.transform("items", lambda v: csv_field(v, delimiter)), delimiter)
    return parts.select(*scope, F.col("chunk").cast("int").alias("part"), line.alias("line"))
