"""Repeated byte windows by a depth-limited radix sort of all suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import group_rank
from ..storage import Workspace
from .common import boxed, raw, row_key, ship, slices
from .suffix_runs import WIDTH, Hashes, runs

ship(__name__)
RUNS, GONE, OPEN, WINDOWS = range(4)
DEALT = "kind int, bucket int, n int, blob binary"
#: Rows that a map task gathers before it combines and deals them.
GATHER = 1_000_000
#: Bytes of a long text that are hashed at once.
PART = 2 << 20
#: Bytes of text that a bucket stands for.
BUCKET_BYTES = 32 << 20
#: Types of ids that order documents.
INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: Second hashes keep 32 bits: with the first one 96 bits tell windows apart.
LOW = np.int64(0xFFFFFFFF)


def place(tag: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A text's number under its id (24 bits), the first window (31 bits) and the number of windows (8 bits)."""
    return (tag << np.int64(39)) | (at << np.int64(8)) | n


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64 bits as one blob; bytes of equal weight stand together, which compresses well."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blobs: list[bytes], counts: list[int], width: int) -> list[np.ndarray]:
    parts = []
    for blob, n in zip(blobs, counts, strict=True):
        flat = pa.decompress(blob, decompressed_size=8 * n * width, codec="zstd", asbytes=True)
        planes = np.frombuffer(flat, np.uint8).reshape(width, 8, n)
        parts.append(np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(width, n))
    return list(np.concatenate(parts, axis=1))


def dealt(kind: int, key: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, bucket, n, blob): the columns' rows dealt to buckets by key."""
    if not len(key):
        return
    bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    stop = np.append(first[1:], len(bucket))
    columns = [c[order] for c in columns]
    blobs = [pack([c[a:b] for c in columns]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(first), kind, np.int32)), pa.array(bucket[first]),
         pa.array((stop - first).astype(np.int32)), pa.array(blobs, pa.binary())],
        names=["kind", "bucket", "n", "blob"])


def spread(ord_: np.ndarray) -> np.ndarray:
    """A well-mixed key for documents."""
    return (ord_.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)


def by_document(kind: int, ord_: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    return dealt(kind, spread(ord_).view(np.int64), [ord_, places], buckets)


def settle_runs(h1, h2, ord_, places, flag) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order rows by (h1, h2, document, place): row order, which rows are later copies of an equal
    run, which first ones share their first digit with a different run (or a flagged row), and
    which are first ones."""
    order = np.lexsort((places, ord_, flag, h2, h1))
    a, b, f = h1[order], h2[order], flag[order]
    new1 = np.append(True, a[1:] != a[:-1])
    new2 = new1 | np.append(True, (b[1:] != b[:-1]) | (f[1:] != f[:-1]))
    group = np.cumsum(new1) - 1
    kinds = np.bincount(group, weights=new2)
    mixed = (kinds > 1) | (np.bincount(group, weights=f) > 0)
    real = f == 0
    return order, ~new2 & real & ~repeats_first(new2, ord_[order], places[order]), new2 & real & mixed[group], new2 & real


def repeats_first(new: np.ndarray, ord_: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether a row stands where the first of its group does: rows equal in id and text."""
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (ord_ == ord_[lead]) & (places == places[lead])


def deal_runs(buckets: int, width: int):
    """Map side of the first passes: cut texts into runs, combine equal ones, deal by first digit."""

    def flush(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h1, h2, ord_, places = (np.concatenate(c) for c in zip(*rows, strict=True))
        order, later, mixed, first = settle_runs(h1, h2, ord_, places, np.zeros(len(h1), np.int64))
        h1, h2, ord_, places = h1[order], h2[order], ord_[order], places[order]
        yield from by_document(GONE, ord_[later], places[later], buckets)
        yield from by_document(OPEN, ord_[mixed], places[mixed], buckets)
        # Of runs that are open already, one marker per first digit tells the others.
        single = first & ~mixed
        marker = np.zeros(len(h1), bool)
        at = np.flatnonzero(mixed)
        marker[at[np.append(True, h1[at][1:] != h1[at][:-1])[:len(at)]]] = True
        send = single | marker
        flag = marker.astype(np.int64)
        yield from dealt(RUNS, h1[send], [c[send] for c in (h1, h2, ord_, places, flag)], buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, have = [], 0
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ords, tags = batch.column("ord").to_numpy(), batch.column("tag").to_numpy()
                for owner, begin, data in blocks_of(raw(batch.column("text")), width):
                    found = runs(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(p) for p in data]), width)
                    doc = owner[found["doc"]]
                    rows.append((found["h1"], found["h2"] & LOW, ords[doc],
                                 place(tags[doc], begin[found["doc"]] + found["at"], found["n"])))
                    have += len(doc)
                    if have >= GATHER:
                        yield from flush(rows)
                        rows, have = [], 0
        if have:
            yield from flush(rows)

    return run


def blocks_of(texts: list[bytes], width: int, most: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(text index, start, bytes) lists of about ``most`` bytes. A longer text comes in parts that
    overlap by all but one byte of a window, so that every window is in exactly one part."""
    owner, begin, data, have = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), most):
            part = text[at:at + most + width - 1]
            owner.append(k)
            begin.append(at)
            data.append(part)
            have += len(part)
            if have >= most:
                yield np.array(owner), np.array(begin), data
                owner, begin, data, have = [], [], [], 0
    if data:
        yield np.array(owner), np.array(begin), data


def bucket_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(kind, blobs, counts) of every (kind, bucket) of a partition sorted by them."""
    now, blobs, counts = None, [], []
    for batch in batches:
        for kind, bucket, n, blob in zip(*[batch.column(c).to_pylist() for c in ("kind", "bucket", "n", "blob")], strict=True):
            if (kind, bucket) != now and blobs:
                yield now[0], blobs, counts
                blobs, counts = [], []
            now = (kind, bucket)
            blobs.append(blob)
            counts.append(n)
    if blobs:
        yield now[0], blobs, counts


def sort_buckets(buckets: int):
    """Reduce side: buckets of runs and of windows are sorted; rows by document pass through."""

    def flush(found: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for kind, rows in found.items():
            yield from by_document(kind, *(np.concatenate(c) for c in zip(*rows, strict=True)), buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        have = 0
        for kind, blobs, counts in bucket_groups(batches):
            if kind == RUNS:
                h1, h2, ord_, places, flag = unpack(blobs, counts, 5)
                order, later, mixed, _ = settle_runs(h1, h2, ord_, places, flag)
                out = [(GONE, ord_[order[later]], places[order[later]]), (OPEN, ord_[order[mixed]], places[order[mixed]])]
            elif kind == WINDOWS:
                h1, h2, ord_, places = unpack(blobs, counts, 4)
                later, _ = later_windows(h1, h2, ord_, places)
                out = [(GONE, ord_[later], places[later])]
            else:
                out = [(kind, *unpack(blobs, counts, 2))]
            for to, ord_, places in out:
                found.setdefault(to, []).append((ord_, places))
                have += len(ord_)
            if have >= GATHER:
                yield from flush(found)
                found, have = {}, 0
        yield from flush(found)

    return run


def later_windows(h1, h2, ord_, places) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose window stands earlier too, and the first row of every window."""
    order = np.lexsort((places, ord_, h2, h1))
    a, b = h1[order], h2[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return order[~new & ~repeats_first(new, ord_[order], places[order])], order[new]


def per_document(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, tag, kind, places) of every document of the sorted buckets; touching places are joined."""
    for kind, blobs, counts in bucket_groups(batches):
        ord_, places = unpack(blobs, counts, 2)
        order = np.lexsort((places, ord_))
        ord_, places = ord_[order], places[order]
        owner = places >> np.int64(39)
        first = np.flatnonzero(np.append(True, (ord_[1:] != ord_[:-1]) | (owner[1:] != owner[:-1])))
        stop = np.append(first[1:], len(ord_))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ord_[first]), pa.array(owner[first]), pa.array(np.full(len(first), kind, np.int32)),
             pa.array([pack([places[a:b]]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)], pa.binary()),
             pa.array((stop - first).astype(np.int32))], names=["ord", "tag", "kind", "places", "n"])


def deal_windows(buckets: int, width: int):
    """Last passes: every window of the open runs by the hash of all its bytes."""

    def flush(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h1, h2, ord_, places = (np.concatenate(c) for c in zip(*rows, strict=True))
        later, send = later_windows(h1, h2, ord_, places)
        yield from by_document(GONE, ord_[later], places[later], buckets)
        yield from dealt(WINDOWS, h1[send], [c[send] for c in (h1, h2, ord_, places)], buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, have = [], 0
        for batch in batches:
            for ord_, tag, text, size, places, n in zip(
                    *[batch.column(c).to_pylist() for c in ("ord", "tag", "packed", "size", "places", "n")], strict=True):
                data = np.frombuffer(pa.decompress(text, size, codec="zstd", asbytes=True), np.uint8)
                own = unpack([places], [n], 1)[0]
                first, many = (own >> np.int64(8)) & np.int64(0x7FFFFFFF), own & np.int64(0xFF)
                ends = np.cumsum(many)
                at = np.arange(ends[-1]) - np.repeat(ends - many, many) + np.repeat(first, many)
                at.sort()
                for base in range(0, size, PART):
                    own = at[np.searchsorted(at, base):np.searchsorted(at, base + PART)]
                    part = data[base:base + PART + width]
                    h1, h2 = (Hashes(part, k).of(own - base, own - base + width).view(np.int64) for k in (0, 1))
                    rows.append((h1, h2 & LOW, np.full(len(own), ord_), place(
                        np.full(len(own), tag), own, np.ones(len(own), np.int64))))
                    have += len(own)
                    if have >= GATHER:
                        yield from flush(rows)
                        rows, have = [], 0
        if have:
            yield from flush(rows)

    return run


def pack_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, so that moving them costs little disk."""
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in rest],
             pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary()),
             pa.array(np.array([len(t) for t in texts], np.int64))], names=[*rest, "packed", "size"])


def removed_spans(places: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte spans covered by windows."""
    own = np.concatenate(places)
    start = (own >> np.int64(8)) & np.int64(0x7FFFFFFF)
    stop = start + (own & np.int64(0xFF)) + (width - 1)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > stop[:-1])
    last = np.append(new[1:], True)
    return start[new], stop[last]


def cut_texts(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, size, gone in zip(*[batch.column(c).to_pylist() for c in ("packed", "size", "gone")], strict=True):
                data = pa.decompress(text, size, codec="zstd", asbytes=True) if size else b""
                if gone:
                    start, stop = removed_spans([unpack([g["places"]], [g["n"]], 1)[0] for g in gone], width)
                    edges = [0, *np.column_stack([start, stop]).ravel().tolist(), size]
                    kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    out.append((size, int((stop - start).sum()), len(start), kept))
                else:
                    out.append((size, 0, 0, data))
            rest = [n for n in batch.schema.names if n not in ("packed", "size", "gone")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in rest], *[pa.array([o[i] for o in out], pa.int64()) for i in range(3)],
                 pa.array([o[3] for o in out], pa.binary()),
                 pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string())],
                names=[*rest, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def order_key(doc_id: Column, text: Column) -> Column:
    """Documents stand in the order of their ids; those with a null id come last, by a text hash."""
    return F.coalesce(doc_id.cast("long"), F.lit(1 << 62).cast("long") + F.xxhash64(text).bitwiseAND(
        F.lit((1 << 61) - 1).cast("long")))


def text_numbers(keys: DataFrame, ws: Workspace) -> DataFrame:
    """``(ord, k1, k2, number)`` of the texts of ids that have several; empty for a table of unique ids."""
    key = F.struct("k1", "k2")
    several = keys.groupBy("ord").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b").select("ord")
    shared = keys.join(several, "ord", "left_semi").select("ord", "k1", "k2").distinct()
    numbered = ws.put(group_rank(shared, ["ord"], ["k1", "k2"], "number", ws), "numbers")
    most = numbered.agg(F.max("number")).first()[0]
    if most is not None and most >> 24:
        raise ValueError(f"{most + 1} different texts under one document id; the limit is {1 << 24}")
    return numbered


def drop_repeats(docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text",
                 width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256)`` of every row of ``docs``.

    Every byte goes that is covered by a ``width``-byte string (33 to 150) which also starts
    earlier: in a document with a smaller id, or in the same one before. Strings are judged on the
    input. ``kept`` is the remaining bytes.

    The suffixes are sorted only through ``width`` bytes, most significant digit first, and leave
    the sort as soon as they stand alone:

    1. The first digit of a suffix is the smallest-hash 32-byte gram in its first ``width`` bytes.
       Neighbouring suffixes mostly share it, so they travel as one run (about 31 suffixes).
    2. Runs that share the first digit are told apart by a hash of all their bytes. Equal runs are
       repeated windows, all but the first. A run alone with its first digit is done.
    3. Runs that share the first digit but differ (the ends of repeats) are opened: their suffixes
       are dealt by 96 bits of hashes of all ``width`` bytes; equal groups are the repeated windows.

    Both deals combine on the map side first (later copies are settled there, and a digit with
    several runs sends one marker), so a passage that a third of all documents share sends one row
    per map batch. Rows travel in compressed blocks per bucket.

    A null text is empty, and texts shorter than ``width`` lose nothing. Texts that share a doc_id
    are numbered in the order of their 128-bit hashes and follow each other in it (at most 2**24
    of them under one id, an error otherwise); rows equal in id and text are one document and get the
    same result. A null id stands after all others. ``doc_id`` is an integer; another type is refused by
    name. Texts must be shorter than 2 GB. An empty table gives an empty one.

    A bucket stands for about ``BUCKET_BYTES`` of text; a task handles one after another, so its memory
    does not follow the size of the table.
    """
    spark = docs.sparkSession
    boxed_docs = boxed(docs, doc_id=doc_id, text=text)
    if boxed_docs.schema["doc_id"].dataType.simpleString() not in INTEGERS:
        raise TypeError(f"{doc_id} orders the documents and must be an integer, not "
                        f"{boxed_docs.schema['doc_id'].dataType.simpleString()}")
    own = boxed_docs.select("doc_id", "text", order_key(F.col("doc_id"), F.col("text")).alias("ord"), *row_key("text"))
    keys = ws.put(own.select("ord", "k1", "k2", F.octet_length("text").alias("size")), "keys")
    bytes_ = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // BUCKET_BYTES))
    own = own.join(text_numbers(keys, ws), ["ord", "k1", "k2"], "left").select(
        "doc_id", "text", "ord", F.coalesce("number", F.lit(0)).cast("long").alias("tag"))
    texts = own.select("ord", "tag", "text")

    def sorted_by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")

    def documents(df: DataFrame, name: str) -> DataFrame:
        settled = sorted_by_bucket(df).mapInArrow(sort_buckets(buckets), DEALT)
        return ws.put(sorted_by_bucket(settled).mapInArrow(
            per_document, "ord long, tag long, kind int, places binary, n int"), name)

    first = documents(texts.mapInArrow(deal_runs(buckets, width), DEALT), "runs")
    moved = texts.mapInArrow(pack_texts, "ord long, tag long, packed binary, size long")
    opened = moved.join(first.filter(F.col("kind") == OPEN).drop("kind"), ["ord", "tag"])
    second = documents(opened.mapInArrow(deal_windows(buckets, width), DEALT), "windows")
    gone = (first.filter(F.col("kind") == GONE).union(second).groupBy("ord", "tag")
            .agg(F.collect_list(F.struct("places", "n")).alias("gone")))
    kept = own.mapInArrow(pack_texts, own.drop("text").select("*", F.lit(b"").alias("packed"), F.lit(0).cast("long").alias("size")).schema)
    met = kept.join(gone, ["ord", "tag"], "left").select("doc_id", "packed", "size", "gone")
    schema = met.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")],
                        F.lit(b"").alias("kept"), F.lit("").alias("kept_sha256")).schema
    return met.mapInArrow(cut_texts(width), schema)


def op10(spark, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return drop_repeats(spark.read.parquet(f"{folder}/documents.parquet"), Workspace(spark)).drop("kept")
