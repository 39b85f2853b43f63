"""What the operators share: row keys, Arrow stages, sorted groups."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Stages carry the code of ``module``, so executors need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame, **own: str) -> DataFrame:
    """``row`` holds all columns of ``df`` as one struct; each ``own`` names a column beside it.

    An operator works on the own columns, so no column of the user can clash with one of its own.
    Catalyst reads only those fields of ``row`` that the result uses.
    """
    return df.select(F.struct(*[named(c).alias(c) for c in df.columns]).alias("row"),
                     *[named(source).alias(name) for name, source in own.items()])


def unboxed(df: DataFrame, columns: Iterable[str], **changed: str) -> DataFrame:
    """The user's columns in their order; ``changed`` says which come from a column beside ``row``."""
    return df.select(*[named(changed[c]).alias(c) if c in changed
                       else F.col("row").getField(c).alias(c) for c in columns])


def row_key(*columns: Column | str) -> list[Column]:
    """128 bits that name a row by its values: equal rows share a key, so their results agree."""
    return [F.xxhash64(F.lit(11), *columns).alias("k1"), F.xxhash64(F.lit(23), *columns).alias("k2")]


def hash_share(column: str, n: int, most: int) -> Column:
    """True for rows in a share of the hashes of ``column`` that holds about a quarter more than
    ``most`` of ``n`` rows: what is ordered and cut afterwards stays bounded in every task."""
    share = min(1.0, 1.25 * most / max(n, 1))
    return F.pmod(F.xxhash64(column), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)) + 1)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of ``column``; a longer value stands alone."""
    ends = np.cumsum(sizes(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of every value, 0 for null."""
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of a partition sorted by ``keys`` that never cut a group.

    The last group of a block waits for the next one.
    """
    wait: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        if wait is not None:
            now = {n: np.concatenate([wait[n], v]) for n, v in now.items()}
        new = starts(now, keys)
        if new[-1]:
            yield {n: v[:new[-1]] for n, v in now.items()}
        wait = {n: v[new[-1]:] for n, v in now.items()}
    if wait is not None:
        yield wait


def starts(block: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Positions where a new key begins."""
    first = block[keys[0]]
    change = np.ones(len(first), bool)
    change[1:] = False
    for k in keys:
        change[1:] |= block[k][1:] != block[k][:-1]
    return np.flatnonzero(change)


def spanning(size: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = 256) -> np.ndarray:
    """Links (child, parent) that hold each connected part of one group together.

    ``near(a, b)`` is the boolean matrix of links between members ``a`` and ``b``. A member is
    looked at once, against those not reached yet, so a dense group costs about its size and
    yields one link per member instead of all pairs.
    """
    rest, found = np.arange(size), []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:step], front[step:]
            m = near(now, rest)
            hit = m.any(axis=0)
            if hit.any():
                new = rest[hit]
                found.append(np.column_stack([new, now[m[:, hit].argmax(axis=0)]]))
                front, rest = np.concatenate([front, new]), rest[~hit]
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)
