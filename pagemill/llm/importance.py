"""Importance resampling towards a target distribution, over hashed word features.

The features are runs of consecutive words, hashed by CRC-32. A word's CRC is looked up once, in
an Aho-Corasick dictionary; the CRC of a run is composed from the CRCs of its words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import group_rank
from ..storage import Workspace
from .common import boxed, raw, row_key, ship, slices
from .vocabulary import frequent, word_counts

ship(__name__)
#: A to Z in lower case; every other ASCII character that is no letter or digit ends a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SPACE = 32
HIT = np.dtype([("end", np.int64), ("word", np.int64)])


def folded_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


# -- CRC-32 of joined strings ---------------------------------------------------------------------

@lru_cache(maxsize=512)
def shifts(length: int) -> np.ndarray:
    """Tables, one per byte of a CRC, that move it past ``length`` more bytes (a linear map of 32 bits)."""
    bits = np.array([1 << i for i in range(32)], np.uint32)
    one = byte_step(bits)                            # images of the 32 bits after one byte
    out, power = bits, one
    while length:
        if length & 1:
            out = applied(power, out)
        power, length = applied(power, power), length >> 1
    tables = np.zeros((4, 256), np.uint32)
    for i in range(32):
        byte, bit = divmod(i, 8)
        tables[byte, np.arange(256) >> bit & 1 == 1] ^= out[i]
    return tables


def byte_step(crc: np.ndarray) -> np.ndarray:
    """The CRC register after eight zero bits."""
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


def applied(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The linear map with the given images of single bits, of each value."""
    out = np.zeros_like(values)
    for i in range(32):
        out ^= np.where(values >> np.uint32(i) & 1, images[i], np.uint32(0))
    return out


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC moved past ``length`` bytes."""
    out = np.empty_like(crc)
    order = np.argsort(length, kind="stable")
    first = np.flatnonzero(np.diff(length[order], prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(crc)], strict=False):
        part = order[a:b]
        t, c = shifts(int(length[part[0]])), crc[part]
        out[part] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return out


# -- The dictionary -------------------------------------------------------------------------------

class Dictionary:
    """Delimiter-bounded words in one automaton; every word carries its CRC and its length."""

    def __init__(self, words: list[bytes]) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            self.automaton.add_word(" " + w.decode("latin-1") + " ", i)
        self.automaton.make_automaton()
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC, length and end of all words of a folded text that begins and ends with a blank.

        The automaton reports the words it holds; words between its hits are hashed on the spot.
        """
        solid = np.frombuffer(text, np.uint8) != SPACE
        start = np.flatnonzero(~solid[:-1] & solid[1:]) + 1
        end = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        crc, length = np.empty(len(end), np.uint32), end - start
        missed = np.ones(len(end), bool)
        if len(self.crc):
            hits = np.fromiter(self.automaton.iter(text.decode("latin-1")), HIT)
            at = np.searchsorted(end, hits["end"])
            crc[at], length[at], missed[at] = self.crc[hits["word"]], self.length[hits["word"]], False
        at = np.flatnonzero(missed)
        crc[at] = np.fromiter((zlib.crc32(text[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)),
                              np.uint32, len(at))
        return crc, length, end


_BUILT: dict[tuple[int, int], Dictionary] = {}


def built(words: list[bytes]) -> Dictionary:
    """One automaton per Python worker, kept for its next task."""
    key = (len(words), hash(tuple(words)))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Dictionary(words)
    return _BUILT[key]


def feature_batches(shared, buckets: int, width: int):
    """The Arrow stage that replaces ``text`` by ``n_words`` and ``buckets``, one 16-bit number per feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = built(shared.value)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                texts = [t.translate(FOLD) for t in raw(batch.column("text"))]
                n_words, numbers, offsets = features(dictionary, texts, buckets, width)
                data = numbers.astype("<u2").tobytes()
                ends = (2 * offsets).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                keep = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(n_words), binary],
                                                 names=[*keep, "n_words", "buckets"])

    return run


def features(dictionary: Dictionary, texts: list[bytes], buckets: int, width: int):
    """``(n_words, numbers, offsets)``: the buckets of all features of folded texts, text after text."""
    crc, length, end = dictionary.scan(b" " + b" ".join(texts) + b" ")
    border = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(end, border, "right")                    # words up to the end of each text
    n_words = np.diff(upto, prepend=0)
    left = np.arange(len(crc)) - np.repeat(upto - n_words, n_words)  # words before it in its text
    owner, joined, all_owners, all_crcs = np.repeat(np.arange(len(texts)), n_words), crc, [], []
    spaced = np.uint32(zlib.crc32(b" "))
    for k in range(1, width + 1):
        if k > 1:       # runs of k words: the run of k - 1 that ends one word earlier, a blank, this word
            before = moved(np.concatenate([joined[:1], joined[:-1]]), np.ones(len(crc), np.int64)) ^ spaced
            joined = moved(before, length) ^ crc
        have = left >= k - 1
        all_owners.append(owner[have])
        all_crcs.append(joined[have])
    owners, crcs = np.concatenate(all_owners), np.concatenate(all_crcs)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(texts))
    return n_words.astype(np.int64), crcs[order] % np.uint32(buckets), np.concatenate([[0], np.cumsum(counts)])


# -- Counting and scoring -------------------------------------------------------------------------

def count_batches(buckets: int):
    """The Arrow stage over ``buckets``: rows ``(bucket, n)``, one per bucket and task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column("buckets"):
                total += np.bincount(np.frombuffer(value.as_buffer(), "<u2"), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    return run


def weight_batches(gains: np.ndarray):
    """The Arrow stage that replaces ``buckets`` by ``n_features`` and ``weight``, the floored mean gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for value in batch.column("buckets"):
                own = gains[np.frombuffer(value.as_buffer(), "<u2")]
                n.append(len(own))
                weight.append(int(own.sum()) // len(own) if len(own) else 0)
            keep = [c for c in batch.schema.names if c != "buckets"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                names=[*keep, "n_features", "weight"])

    return run


def bucket_counts(hashed: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows; the driver gets one number per bucket."""
    rows = (hashed.select("buckets").mapInArrow(count_batches(buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket ``floor(1000 ln ((t + 1)(S + b) / ((s + 1)(T + b))))`` for b buckets."""
    b = len(source)
    all_s, all_t = int(source.sum()) + b, int(target.sum()) + b
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(seed: int, doc_id: Column) -> Column:
    """``floor(-1000 ln(-ln u))`` with u from the SHA-256 of seed and id; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text",
                        target_text: str = "text", buckets: int = 10_000, width: int = 2, share: int = 25,
                        least: int = 20, seed: int = 7, one_in: int = 1 << 18) -> DataFrame:
    """``(doc_id, k1, k2, n_words, n_features, weight, score, rank)`` for every row of ``docs``.

    Texts are A-Z lower-cased; words are runs of ASCII letters, digits and characters beyond ASCII.
    Features are all runs of 1 to ``width`` words, joined by one blank, in ``buckets`` <= 65,536
    buckets by CRC-32. A bucket's gain is the floored thousandfold log ratio of its smoothed shares
    in ``target`` and ``docs``; ``weight`` is the floored mean gain over a document's features and
    ``score`` adds Gumbel noise drawn from seed and id. Of the documents with ``least`` words,
    ``share`` percent are drawn by score and ranked from 1; ``rank`` is null for the others.

    The dictionary holds the words that make up one in ``one_in`` of all word occurrences, at most
    ``one_in`` words of 64 bytes; words between its hits are hashed where they stand, so the result
    does not depend on it. Texts are scanned once; their bucket numbers are kept (2 bytes a
    feature) for counting and scoring. Ranks come from range partitions, no task sees all rows.

    Null and empty texts and texts without words have no features and weight 0. Ties go to the
    smaller id, null ids last; equal rows take neighbouring ranks. Without target texts the shares
    are those of smoothing alone. ``k1, k2`` hash id and text. No rows give no rows; further
    columns are not looked at.
    """
    own = boxed(docs, doc_id=doc_id, text=text).select("doc_id", "text")
    counts = word_counts(own, folded_words)
    counts = ws.put(counts, "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = docs.sparkSession.sparkContext.broadcast([w for w, _ in frequent(counts, total, one_in)])
    stage = feature_batches(shared, buckets, width)
    kind = own.schema["doc_id"].dataType.simpleString()
    keyed = own.withColumns(dict(zip(("k1", "k2"), row_key("doc_id", "text"), strict=True)))
    hashed = ws.put(keyed.select("doc_id", "k1", "k2", "text").mapInArrow(
        stage, f"doc_id {kind}, k1 long, k2 long, n_words long, buckets binary"), "hashed")
    wanted = boxed(target, text=target_text).select("text").mapInArrow(stage, "n_words long, buckets binary")
    gains = log_ratios(bucket_counts(hashed, buckets), bucket_counts(wanted, buckets))
    weighed = hashed.mapInArrow(weight_batches(gains),
                                f"doc_id {kind}, k1 long, k2 long, n_words long, n_features long, weight long")
    scored = ws.put(weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))), "scored")
    drawn = scored.filter(F.col("n_words") >= least).count() * share // 100
    ordered = scored.withColumns({"_short": F.col("n_words") < least, "_low": -F.col("score"),
                                  "_unnamed": F.isnull("doc_id")})
    placed = group_rank(ordered, [], ["_short", "_low", "_unnamed", "doc_id", "k1", "k2"], "_place", ws)
    rank = F.when(~F.col("_short") & (F.col("_place") < drawn), F.col("_place") + 1)
    return placed.withColumn("rank", rank).drop("_short", "_low", "_unnamed", "_place")


def op13(spark, folder: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, towards the texts of ``benchmark``."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    done = importance_resample(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), Workspace(spark))
    return done.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
