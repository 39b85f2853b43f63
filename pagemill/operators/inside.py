"""Containment join of node tables: nodes inside other nodes, by their pre-order intervals."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get this module's code with the plan, as in ``functions.dom``.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Places of a page that one task sorts together: a longer page is cut into such segments.
SEGMENT = 1 << 16
#: Pairs in one output batch; a single node's pairs within a segment stay together.
PAIRS = 1 << 16


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of sorted rows that never cut a group, with the number of each row's group."""
    wait: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch if wait is None else pa.concat_batches([wait, batch])
        group = group_numbers(block, keys)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield block.slice(0, cut), group[:cut]
        wait = block.slice(cut)
    if wait is not None:
        yield wait, group_numbers(wait, keys)


def group_numbers(block: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """0, 1, 2, ... for the runs of equal keys; keys are not null."""
    new = np.zeros(block.num_rows, bool)
    for k in keys:
        column = block.column(k)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def inside_batches(keys: list[str]):
    """The Arrow stage over rows of both sides sorted by keys, segment and place.

    A node's inner nodes are neighbours in that order: from the first one after its own place to
    the last one up to its end. Both ends are found by halving, so the work follows rows and pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in whole_groups(batches, [*keys, "_segment"]):
            pre = block.column("_pre").to_numpy(zero_copy_only=False).astype(np.int64)
            last = pc.fill_null(block.column("_last"), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            outer, inner = np.flatnonzero(last >= 0), np.flatnonzero(last < 0)
            place = group[inner] << 32 | pre[inner]
            low = np.searchsorted(place, group[outer] << 32 | pre[outer], "right")
            high = np.searchsorted(place, group[outer] << 32 | last[outer], "right")
            count = np.maximum(high - low, 0)
            upto = np.cumsum(count)
            at = 0
            while at < len(outer):
                base = upto[at] - count[at]
                stop = max(at + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
                n = count[at:stop]
                chosen = np.arange(n.sum()) + np.repeat(low[at:stop] - (np.cumsum(n) - n), n)
                if len(chosen):
                    rows = block.take(pa.array(inner[chosen]))
                    payload = rows.column("_row")
                    yield pa.RecordBatch.from_arrays(
                        [*[rows.column(k) for k in keys], *payload.flatten(), pa.array(np.repeat(pre[outer[at:stop]], n), pa.int32())],
                        names=[*keys, *payload.type.names, "outer_pre"])
                at = stop

    return run


def join_inside(outer: DataFrame, inner: DataFrame, *keys: str, segment: int | None = None) -> DataFrame:
    """Inner nodes strictly inside outer ones: the inner row and ``outer_pre``, once per such pair.

    Both sides are node tables (see ``dom.node_table``), already filtered. Rows meet by page and
    segment of ``segment`` places: an inner node lies in one segment, an outer one is entered in every
    segment that it reaches into, so one page with very many nodes is several tasks' work. Within a
    segment no pair is looked at that is not a result. Rows with a null key have no page.
    Prefer :func:`select.select_path` on shredded pages, which needs no join.
    """
    length = F.lit(segment or SEGMENT)
    rest = [c for c in inner.columns if c not in keys]
    have = [F.col(k).isNotNull() for k in keys]

    def number(c: str) -> Column:
        return F.floor(F.col(c) / length).cast("int")

    known = have[0]
    for h in have[1:]:
        known = known & h
    row = F.struct(*rest)
    blank = F.lit(None).cast(inner.select(row.alias("r")).schema["r"].dataType)
    wide = outer.filter(known & (F.col("last") > F.col("pre"))).withColumn("_from", F.col("pre") + 1).select(
        *keys, F.explode(F.sequence(number("_from"), number("last"))).alias("_segment"), F.col("pre").alias("_pre"),
        F.col("last").alias("_last"), blank.alias("_row"))
    narrow = inner.filter(known).select(*keys, number("pre").alias("_segment"), F.col("pre").alias("_pre"),
                                        F.lit(None).cast("int").alias("_last"), row.alias("_row"))
    both = narrow.unionByName(wide).repartition(*keys, "_segment").sortWithinPartitions(*keys, "_segment", "_pre")
    fields = [inner.schema[c] for c in (*keys, *rest)]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("outer_pre", T.IntegerType())])
    return both.mapInArrow(inside_batches(list(keys)), schema)
