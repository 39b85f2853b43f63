"""SimHash near-duplicates: fingerprints linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import boxed, raw, row_key, ship, slices, sorted_groups, spanning, starts, unboxed
from .components import connected_components

ship(__name__)
SEED = 42


def fingerprint(text: bytes, width: int) -> int:
    """64-bit SimHash of the ``width``-word shingles of one text, 0 if it has no word."""
    words = text.lower().split()            # of bytes: ASCII letters and ASCII white space only
    n = len(words) - width + 1
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < 2:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], ends[:n - 1] + 1]).tolist()
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin, ends[width - 1:].tolist(), strict=True)),
                    np.uint64, n)
    ones = np.zeros(64, np.int64)
    for part in range(0, n, 1 << 16):
        bits = np.unpackbits(h[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                fp = np.array([fingerprint(t, width) for t in raw(batch.column("text"))], np.uint64)
                keep = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in keep], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return run


#: Members of a group that are compared block by block; a larger group is indexed once more.
DENSE = 1024


def block_links(fp: np.ndarray, bits: int) -> np.ndarray:
    """Links that connect up to :data:`DENSE` distinct fingerprints, at most two for each."""
    near = np.bitwise_count(fp[:, None] ^ fp) <= bits
    if near.sum() <= 5 * len(fp):                # few links are given as they are, many as a spanning forest
        child, parent = np.nonzero(near)
        return np.column_stack([fp[child], fp[parent]])[child > parent]
    return fp[spanning(len(fp), lambda a, b: near[np.ix_(a, b)])]


def group_links(fp: np.ndarray, low: bool, bits: int) -> Iterator[np.ndarray]:
    """Links (child, parent) that connect one group: fingerprints about equal in one half.

    Members that differ in at most 5 bits differ, in the other half, in at most 2 bits of one of its
    16-bit parts. A large group is entered once more under all values within 1 bit of those parts,
    as in :func:`link_fingerprints`, so that only members that are close there as well are compared.
    ``low`` tells whether the group agrees in the low half.
    """
    if len(fp) <= DENSE:
        yield block_links(fp, bits)
        return
    other = (fp >> np.uint64(32) if low else fp & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    masks = np.array([0, *[1 << i for i in range(16)]], np.uint32)
    for shift in (0, 16):
        part = other >> np.uint32(shift) & np.uint32(0xFFFF)
        key = (part[:, None] ^ masks).ravel()
        order = np.argsort(key, kind="stable")
        own, ranked = np.repeat(fp, len(masks))[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        for at, n in zip(first.tolist(), np.diff(np.append(first, len(own))).tolist(), strict=True):
            near = own[at:at + n]
            if 1 < n <= DENSE:
                yield block_links(near, bits)
            elif n > DENSE:
                yield near[spanning(n, lambda a, b, near=near: np.bitwise_count(near[a][:, None] ^ near[b]) <= bits)]


def ball_links(bits: int):
    """The Arrow stage over (key, fp) sorted by key: links of fingerprints that differ in few bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_groups(batches, ["key"]):
            first = starts(block, ["key"])
            fp = block["fp"].view(np.uint64)
            count = np.diff(np.append(first, len(fp)))
            two = first[count == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits
            found = [np.column_stack([fp[two][near], fp[two + 1][near]])]
            for at, n in zip(first[count > 2], count[count > 2], strict=True):
                found += group_links(fp[at:at + n], bool(block["key"][at] >> 32 == 0), bits)
            links = np.concatenate(found).view(np.int64)
            if len(links):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], names=["a", "b"])

    return run


def link_fingerprints(table: DataFrame, bits: int = 4) -> DataFrame:
    """Links ``(a, b)`` that connect all values of ``fp`` (distinct, 64 bits) within ``bits`` <= 5 bits.

    The fingerprint has two segments of 32 bits. Two that differ in at most 5 bits differ in at
    most 2 bits of one segment. Every fingerprint is entered under all values within 1 bit of its
    segments (33 each), and two values at distance 2 share such a value, so probing and the table
    are one: rows under the same value are compared in full, large groups after :func:`group_links` has
    told them apart by the other segment. Within one value the links are a spanning forest, not all
    pairs, and every part of the exact graph stays connected.
    """
    balls = [F.struct(F.lit(s).alias("s"), F.lit(m).cast("long").alias("m"))
             for s in (0, 1) for m in [0, *[1 << i for i in range(32)]]]
    half = F.lit(0xFFFFFFFF).cast("long")
    spread = table.select("fp", F.explode(F.array(*balls)).alias("p")).select(
        (F.when(F.col("p.s") == 0, F.col("fp").bitwiseAND(half))
         .otherwise(F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32).cast("long")))
         .bitwiseXOR(F.col("p.m"))).alias("key"), "fp")
    return (spread.repartition("key").sortWithinPartitions("key")
            .mapInArrow(ball_links(bits), "a long, b long").distinct())


def simhash_groups(docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", width: int = 4,
                   bits: int = 4) -> DataFrame:
    """``(doc_id, k1, k2, fp, root, component_id)`` for every row of ``docs``.

    Texts are A-Z lower-cased; words are runs without ASCII white space; shingles of ``width``
    words, repeats included, vote on each of 64 bits by XXH64. Documents whose fingerprints differ
    in at most ``bits`` are linked; ``component_id`` is the smallest ``doc_id`` reachable.

    Fewer words than ``width``: the whole sequence is the one shingle; no word (null or empty
    text): fingerprint zero, linked like any other. A null ``doc_id`` is never the smallest; a part
    of null ids only has a null ``component_id``. Repeated rows share their fingerprint. An empty
    table gives an empty one.

    Copies collapse to one fingerprint before any linking, so a group of copies of any size is one
    row there; near copies are at most all fingerprints of one small ball.
    """
    keyed = boxed(docs, doc_id=doc_id, text=text).withColumns(
        dict(zip(("k1", "k2"), row_key("doc_id", "text"), strict=True)))
    schema = keyed.select("doc_id", "k1", "k2", F.lit(0).cast("long").alias("fp")).schema
    prints = ws.put(keyed.select("doc_id", "k1", "k2", "text").mapInArrow(fingerprint_batches(width), schema),
                    "fingerprints")
    table = ws.put(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "table")
    links = ws.put(link_fingerprints(table, bits), "links")
    parts = connected_components(links, ws, "parts")
    rooted = table.join(parts, table["fp"] == parts["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = ws.put(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    return prints.join(named, "fp")


def op9(spark, folder: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    done = simhash_groups(docs, Workspace(spark))
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The pipeline's stage: the document with the smallest id of every group stays."""
    ws = Workspace(spark)
    groups = simhash_groups(docs, ws)
    kept = groups.groupBy("root").agg(
        F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "k1", "k2")).alias("k")).select("k.k1", "k.k2")
    own = boxed(docs, doc_id="doc_id", text="text").withColumns(
        dict(zip(("k1", "k2"), row_key("doc_id", "text"), strict=True)))
    return unboxed(own.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), docs.columns)
