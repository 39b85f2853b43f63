"""Near-duplicate vectors: spherical k-means cells and blocked cosine products inside them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import boxed, hash_share, ship, spanning
from .components import connected_components

ship(__name__)
BLOCK = 1024


def sound(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, scaled by their largest component first so that no square overflows."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Unit centroids: the mean direction of the rows with the largest cosine to each."""
    u = unit(rows)
    start = np.random.default_rng(seed).choice(len(u), min(cells, len(u)), replace=False)
    c = u[np.sort(start)]
    for _ in range(rounds):
        own = (u @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, u)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def fit_cells(vectors: DataFrame, most: int = 20_000, per_cell: int = 5_000) -> dict[int, np.ndarray]:
    """Centroids by dimension, from at most ``most`` vectors chosen by hash (a bounded
    sample, the same in every run); one cell per ``per_cell`` vectors, at most 64."""
    n = vectors.count()
    cells = max(1, min(64, n // per_cell))
    rows = vectors.filter(hash_share("embedding", n, most)).select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(most).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r[0]), []).append(r[0])
    return {d: spherical_kmeans(np.array(v, float), cells) for d, v in by.items()}


def assign_batches(centroids: dict[int, np.ndarray], least: float):
    """One row per cell that a vector is compared in: its own, and those it may have links into.

    A linked pair is at most ``sqrt(2 - 2 least)`` apart. With own cells c and d, the two margins
    by which they prefer their own centroid add up to at most that distance times ``|c - d|``, so
    one of the two margins is within half of it. Each vector therefore visits the cells within half
    of it, and every linked pair meets in the own cell of one of them: nothing is lost.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * least)) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            dims = np.array([len(v) for v in vectors])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                u = unit(flat)
                c = centroids.get(int(d), u[:1] * 0)
                s = u @ c.T
                own = s.argmax(axis=1)
                gap = np.linalg.norm(c[:, None] - c[None], axis=2)[own]
                visit = s[np.arange(len(u)), own][:, None] - s <= reach * gap + 1e-9
                visit[np.arange(len(u)), own] = True
                mask = (visit.astype(np.uint64) << np.arange(len(c), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                row, cell = np.nonzero(visit)
                take = pa.array(at[row])
                blobs = [x.tobytes() for x in flat]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").take(take), pa.array(np.full(len(row), d, np.int32)),
                     pa.array(cell.astype(np.int32)), pa.array(own[row].astype(np.int32)),
                     pa.array(mask.view(np.int64)[row]), batch.column("node").take(take),
                     batch.column("copies").take(take), pa.array([blobs[r] for r in row], pa.binary())],
                    names=["label", "dim", "cell", "own", "mask", "node", "copies", "vector"])

    return run


def compare_blocks(least: float, kind: str):
    """Links between a block of vectors at home in a cell and a block of all that visit it:
    (a, b, n); with b null, n more links of node a."""

    def run(table: pa.Table) -> pa.Table:
        t = {n: table.column(n).to_numpy() for n in ("side", "own", "mask", "node", "copies", "cell")}
        u = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(table.num_rows, -1))
        cell, node, copies = t["cell"][0], t["node"], t["copies"]
        x, y = np.flatnonzero(t["side"] == 0), np.flatnonzero(t["side"] == 1)
        ok = u[x] @ u[y].T >= least
        ok &= node[x][:, None] != node[y]
        # Vectors of different homes may meet in both; the smaller cell counts them.
        guest = np.flatnonzero(t["own"][y] != cell)
        home = t["own"][y][guest]
        also = (t["mask"][x].view(np.uint64)[:, None] >> home.astype(np.uint64)) & np.uint64(1)
        ok[:, guest] &= ~(also.astype(bool) & (home < cell))
        from_x, from_y = ok @ copies[y], np.zeros(len(y), np.int64)
        from_y[guest] = copies[x] @ ok[:, guest]            # two vectors at home meet both ways round

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            m = np.zeros((len(a), len(b)), bool)
            ax, bx = a < len(x), b < len(x)
            m[np.ix_(ax, ~bx)] = ok[np.ix_(a[ax], b[~bx] - len(x))]
            m[np.ix_(~ax, bx)] = ok[np.ix_(b[bx], a[~ax] - len(x))].T
            return m

        linked = np.concatenate([np.flatnonzero(ok.any(axis=1)), len(x) + np.flatnonzero(ok.any(axis=0))])
        pairs = linked[spanning(len(linked), lambda a, b: near(linked[a], linked[b]))] if len(linked) else \
            np.empty((0, 2), np.int64)
        nodes = np.concatenate([node[x], node[y]])
        links = np.concatenate([from_x, from_y])
        some = links > 0
        return pa.table({
            "a": pa.array(np.concatenate([nodes[some], nodes[pairs[:, 0]]])),
            "b": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(nodes[pairs[:, 1]])]),
            "n": pa.array(np.concatenate([links[some], np.zeros(len(pairs), np.int64)]).astype(np.int64))})

    return run


def vector_groups(table: DataFrame, ws: Workspace, vec_id: str = "vec_id", embedding: str = "embedding",
                  label: str = "label", least: float = 0.93, block: int = BLOCK) -> DataFrame:
    """``(row, vec_id, n_links, component_id)`` for every row of ``table``.

    Two vectors of equal, non-null label and equal dimension are linked if their cosine in double
    precision is at least ``least``. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest ``vec_id`` reachable, the row itself included.

    Vectors that are null, empty or zero, or hold a null or non-finite component, and vectors
    without a label link with nothing. Rows that repeat a vector under one label are linked like
    others and count one by one. A null ``vec_id`` is never the smallest. An empty table gives an
    empty one.

    Copies of a vector become one weighted node first. Cells come from a bounded sample, every
    vector is assigned, and the visiting rule loses no link. Blocks of about ``block`` vectors at
    home in a cell meet blocks of four times as many visitors, so a crowded cell is many bounded tasks; a pair of blocks yields
    link counts and a spanning forest, never all pairs. Where vectors have no cluster structure the
    visits grow towards all cells: the price of losing nothing.
    """
    own = boxed(table, vec_id=vec_id, embedding=embedding, label=label)
    keyed = own.withColumn("vector", F.when(sound(F.col("embedding")) & F.col("label").isNotNull(), F.col("embedding")))
    kind = "f4" if "float" in own.schema["embedding"].dataType.simpleString() else "f8"
    nodes = ws.put(
        keyed.filter("vector IS NOT NULL").groupBy("label", F.col("vector").alias("embedding"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    label_type = nodes.schema["label"].dataType.simpleString()
    visits = ws.put(nodes.select("label", "embedding", "copies", "node").mapInArrow(
        assign_batches(fit_cells(nodes), least),
        f"label {label_type}, dim int, cell int, own int, mask long, node long, copies long, vector binary"), "visits")
    key = ["label", "dim", "cell"]
    at_home = F.col("own") == F.col("cell")
    sizes = visits.groupBy(*key).agg(
        F.ceil(F.count(F.lit(1)) / (4 * block)).cast("int").alias("guests"),
        F.greatest(F.lit(1), F.ceil(F.count(F.when(at_home, 1)) / block).cast("int")).alias("homes"))
    placed = visits.join(sizes, key).withColumn("h", F.xxhash64("node"))
    carried = [*key, "own", "mask", "node", "copies", "vector"]

    def side(rows: DataFrame, number: int, own: str, other: str) -> DataFrame:
        """Every row once per block of the other side."""
        mine = F.pmod("h", F.col(own)).cast("int")
        every = rows.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        ends = ("mine", "theirs") if number == 0 else ("theirs", "mine")
        return every.select(*carried, F.col(ends[0]).alias("i"), F.col(ends[1]).alias("j"), F.lit(number).alias("side"))

    paired = side(placed.filter(at_home), 0, "homes", "guests").union(side(placed, 1, "guests", "homes"))
    found = ws.put(paired.groupBy(*key, "i", "j").applyInArrow(compare_blocks(least, kind), "a long, b long, n long"), "found")
    parts = connected_components(found.filter("b IS NOT NULL").select("a", "b"), ws, "parts")
    links = found.groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("links"))
    rooted = (nodes.select("label", "embedding", "copies", "first", "node")
              .join(parts.withColumnRenamed("node", "p"), F.col("node") == F.col("p"), "left")
              .join(links, F.col("node") == F.col("of"), "left")
              .withColumn("root", F.coalesce("root", "node")))
    least_id = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    done = ws.put(rooted.join(least_id, "root").select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), "component_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links")), "done")
    met = keyed.join(done, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("e")), "left")
    return met.select("row", "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(groups: DataFrame) -> DataFrame:
    """Rows whose id names their group: one per group where ids are unique."""
    return groups.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8(spark, folder: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return representatives(vector_groups(vectors, Workspace(spark))).drop("row")
