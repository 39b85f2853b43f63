"""Periodic runs of words, found through a dictionary of basic factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, raw, ship, slices

ship(__name__)
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def progressions(places: np.ndarray, key: np.ndarray, near: int) -> tuple[np.ndarray, ...]:
    """One level of the dictionary, from the ``key`` of the factor that starts at each of ``places``.

    Returns ``(names, again, start, step, count)``: a number for every factor, whether the factor
    occurs more than once, and the stretches of ``count`` neighbouring places where a factor, its
    successor occurrence and that one's successor stand ``step <= near`` apart.
    """
    order = np.argsort(key, kind="stable")           # equal factors stand together, by place
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    names = np.empty(len(key), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    after = np.full(len(key), -1, np.int64)          # which of the places holds the successor
    after[order[:-1][same]] = order[1:][same]
    again = after >= 0
    again[order[1:][same]] = True
    gap = np.where(after >= 0, places[after] - places, 0)
    at = np.flatnonzero((gap > 0) & (gap <= near))
    at = at[gap[after[at]] == gap[at]]
    at = at[np.lexsort((at, gap[at]))]
    step, place = gap[at], places[at]
    new = np.flatnonzero(np.diff(step, prepend=0).astype(bool) | (np.diff(place, prepend=-2) != 1))
    return names, again, place[new], step[new], np.diff(new, append=len(at))


def agree(words: np.ndarray, at: int, other: int, way: int, most: int) -> int:
    """How many words from ``at`` and ``other`` on are equal, going up (``way`` 1) or down (-1), at most ``most``."""
    done, size = 0, 16
    while done < most:
        size = min(size, most - done)
        if way > 0:
            equal = words[at + done:at + done + size] == words[other + done:other + done + size]
        else:
            equal = (words[at - done - size + 1:at - done + 1] == words[other - done - size + 1:other - done + 1])[::-1]
        if not equal.all():
            return done + int(equal.argmin())
        done, size = done + size, size * 4
    return done


def runs(words: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows ``(start, length, period)`` of all maximal runs of the sequence ``words``, by start, then period.

    A run repeats its smallest period at least ``times`` >= 3 times and has ``least`` words. Factors of
    1, 2, 4, ... words get numbers, each level from pairs of the one before. Inside a run of period
    q a factor of q to 2q - 1 words recurs after exactly q places (the repeated word is primitive),
    so at the level of that length the places of the run form arithmetic progressions of step q, at
    most the factor's length, and every run is proposed. Proposals are extended word by word, each
    stretch of one period once; those shared by several levels count once. A stretch
    long enough cannot have a smaller period: its factors would have come back sooner.
    Factors that occur once are dropped before the next level, so plain prose ends after a few.
    """
    n, size = len(words), 1
    found: set[tuple[int, int, int]] = set()
    places, key = np.arange(n), words
    while len(places):
        names, again, starts, steps, counts = progressions(places, key, 2 * size)
        # Up to the factor's length all places of a run show its step, so the stretch is already whole.
        short = (steps <= size) & (counts - 1 + size + 2 * steps < np.maximum(least, times * steps))
        end: dict[int, int] = {}
        for at, q in zip(starts[~short].tolist(), steps[~short].tolist(), strict=True):
            if at < end.get(q, 0):                    # inside the stretch that was just extended
                continue
            right = at + agree(words, at, at + q, 1, n - at - q)
            left = at - agree(words, at - 1, at - 1 + q, -1, at)
            end[q] = right
            if right + q - left >= max(least, times * q):
                found.add((left, right + q - left, q))
        # The next level: pairs of neighbouring factors that both occur again.
        places, names = places[again], names[again]
        other = np.searchsorted(places, places + size)
        pair = other < len(places)
        pair[pair] = places[other[pair]] == places[pair] + size
        key = names[pair] * n + names[other[pair]]
        places = places[pair]
        size *= 2
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def surplus(n: int, found: np.ndarray) -> np.ndarray:
    """True for words that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change)[:n] > 0


def run_batches(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                yield found_in(batch, least, times)

    return run


def found_in(batch: pa.RecordBatch, least: int, times: int) -> pa.RecordBatch:
    """The runs of all texts of a batch at once: words carry their document, so none crosses a border."""
    parts = [t.split() for t in raw(batch.column("text"))]      # of bytes: ASCII white space only
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    words = [w for p in parts for w in p]
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    doc = np.repeat(np.arange(len(parts)), counts)
    seq = doc * max(1, len(names)) + np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    seq = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    found = runs(seq, least, times)
    gone = surplus(len(seq), found)
    begin = np.concatenate([[0], np.cumsum(counts)])
    owner = doc[found[:, 0]]
    offsets = np.searchsorted(owner, np.arange(len(parts) + 1))
    entries = pa.StructArray.from_arrays(
        [pa.array(found[:, 0] - begin[owner]), pa.array(found[:, 1].copy()), pa.array(found[:, 2].copy())],
        names=["start", "length", "period"])
    texts = []
    for k, p in enumerate(parts):
        if offsets[k] < offsets[k + 1]:
            drop = gone[begin[k]:begin[k + 1]]
            p = [w for w, d in zip(p, drop.tolist(), strict=True) if not d]
        texts.append(b" ".join(p))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries),
         pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def word_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row of ``docs``.

    Words are runs without ASCII white space, numbered from 0. ``runs`` lists ``(start, length,
    period)`` of the maximal stretches that repeat their smallest period at least ``times`` times
    and have ``least`` words, by start, then period. ``collapsed`` is the text with every run cut
    to its first period, words joined by one blank.

    One map stage, no shuffle: a document is looked at whole, whatever its length. Null and empty
    texts and texts of white space have no words, no runs and an empty ``collapsed``. Repeated rows
    give repeated rows; a null ``doc_id`` stays null; no rows give no rows. Further columns of
    ``docs`` are not looked at, whatever their names.
    """
    own = boxed(docs, doc_id=doc_id, text=text).select("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run_batches(least, times), FOUND.replace("doc_id long", f"doc_id {kind}", 1))


def longest_power(found: Column) -> Column:
    """The run with the greatest exact length / period; the first of equals."""
    def better(best: Column, r: Column) -> Column:
        ahead = best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
        return F.when(ahead, r).otherwise(best)

    return F.aggregate(found, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


def planted(docs: DataFrame) -> DataFrame:
    """``documents`` with the periodic stretches that the query's contract writes into every tenth text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    staged = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    n = F.size("w")
    chosen = (F.col("h") % 10 == 0) & F.col("doc_id").isNotNull()
    staged = staged.withColumn("w", F.when(chosen, words))
    staged = staged.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    staged = staged.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    written = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get(F.col("w"), F.col("a") + (i - F.col("a")) % F.col("p"))))
    return staged.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(written, " "))
                         .otherwise(F.col("text")).alias("text"))


def op11(spark, folder: str) -> DataFrame:
    """doc_id, n_runs, the run of highest power and digests of runs and collapsed text, of every document."""
    found = word_runs(planted(spark.read.parquet(f"{folder}/documents.parquet")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    best = found.withColumn("best", longest_power(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
