"""Word counts of a whole corpus and the part of them that is small enough to travel with a stage."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, ship, slices

ship(__name__)
#: Distinct words that a task holds before it hands their counts on.
HELD = 400_000


def count_batches(words: Callable[[bytes], list[bytes]], held: int = HELD):
    """The Arrow stage over ``text``: rows ``(word, n)``, equal words combined inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            yield from slices(batch, "word", 4 << 20)

        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                for text in raw(batch.column("text")):
                    seen.update(words(text))
                    if len(seen) > held:
                        yield from out()
        yield from out()

    return run


def word_counts(texts: DataFrame, words: Callable[[bytes], list[bytes]]) -> DataFrame:
    """``(word binary, n long)`` of every distinct word of the column ``text``, as UTF-8."""
    return (texts.select("text").mapInArrow(count_batches(words), "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def frequent(counts: DataFrame, total: int, one_in: int, longest: int = 64) -> list[tuple[bytes, int]]:
    """``(word, n)`` of the words that make up at least one in ``one_in`` of ``total`` occurrences,
    most frequent first.

    At most ``one_in`` words can do so, whatever the corpus, and words of more than ``longest``
    bytes are left out: the list never exceeds ``one_in * longest`` bytes. Callers find another
    exact way for all other words.
    """
    rows = counts.filter((F.col("n") * one_in >= total) & (F.octet_length("word") <= longest)).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda r: (-r[1], r[0]))
