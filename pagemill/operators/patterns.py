"""Sets of URL patterns as a table: many patterns for many URLs without trying each on each.

A pattern can only be found in a URL that contains its required text. A few characters of that
text, a gram, index the pattern; URLs are cut into grams of the same length and meet the patterns of
their set in an equi-join, and only those are tried.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get this module's code with the plan, as in ``functions.dom``.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of a gram.
GRAM = 5
#: Compiled patterns that a Python worker keeps.
_KEPT = 50_000

_PIECE = re.compile(r"\\[1-9]\d?|\\x[0-9a-fA-F]{2}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?[^):]*[:)]?|.", re.DOTALL)
_TIMES = re.compile(r"[*?+][+?]?|\{(\d*)(?:,\d*)?\}[+?]?")


@lru_cache(maxsize=_KEPT)
def compiled(pattern: str) -> re.Pattern:
    try:
        return re.compile(pattern)
    except re.error as problem:
        raise ValueError(f"not a URL pattern: {pattern!r}: {problem}") from None


def required_text(pattern: str) -> str:
    """The longest text that every match contains, as far as it can be told from the pattern's top level.

    Brackets, alternatives and anything with special rules are not looked into; the answer may be
    shorter than possible, or empty, but never wrong.
    """
    if "(?" in pattern:                       # flags and look-arounds change what is required
        return ""
    runs, run, depth, pos = [], "", 0, 0
    while pos < len(pattern):
        m = _PIECE.match(pattern, pos)
        piece, pos = m[0], m.end()
        times = _TIMES.match(pattern, pos)
        if times:
            pos = times.end()
        if piece == "|" and depth == 0:
            return ""
        if piece in "()":
            depth += 1 if piece == "(" else -1
            runs.append(run)
            run = ""
            continue
        if len(piece) == 1:
            text = "" if piece in ".^$" else piece
        else:
            text = piece[1] if piece[0] == "\\" and len(piece) == 2 and not piece[1].isalnum() else ""
        needed = times is None or times[0][0] == "+" or (times[1] or "0").strip("0") != ""
        if depth or not text or not needed:
            runs.append(run)
            run = ""
        elif times:                            # at least once, then something unknown
            runs.append(run + text)
            run = ""
        else:
            run += text
    return max([*runs, run], key=len)


def _gram(pattern: str) -> str | None:
    """The last characters of the required text: paths tell more apart than schemes."""
    compiled(pattern)
    text = required_text(pattern)
    return text[-GRAM:] if len(text) >= GRAM else None


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = pa.array([_gram(p) for p in batch.column("pattern").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, grams], names=[*batch.schema.names, "gram"])


def _try_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("pattern").to_pylist(), batch.column("url").to_pylist(), strict=True)
        yield batch.filter(pa.array([compiled(p).search(u) is not None for p, u in pairs], pa.bool_())).drop_columns(["pattern"])


def pattern_table(patterns: DataFrame) -> DataFrame:
    """``(set_id, pattern)`` -> the same rows, each once, with ``gram``; null where no text is required.

    Patterns are Python's, searched for anywhere in a URL. Null ids and patterns are left out; one
    that does not compile is an error that names it.
    """
    rows = patterns.select("set_id", "pattern").dropna().distinct()
    return rows.mapInArrow(_gram_batches, T.StructType([*rows.schema.fields, T.StructField("gram", T.StringType())]))


def matching_urls(urls: DataFrame, table: DataFrame) -> DataFrame:
    """``(set_id, url)``, each once, of the URLs in which a pattern of their set is found.

    ``table`` is a stored :func:`pattern_table`. A URL meets the patterns that share a gram with it,
    and those of its set without one; each is tried once, compiled once per Python worker.
    """
    own = urls.select("set_id", "url").dropna().distinct()
    last = F.length("url") - GRAM + 1
    grams = F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring("url", i, F.lit(GRAM)))))
    cut = own.join(table.filter(F.col("gram").isNotNull()).select("set_id").distinct(), "set_id", "left_semi").select(
        "set_id", "url", F.explode(grams).alias("gram"))
    indexed = cut.join(table.filter(F.col("gram").isNotNull()), ["set_id", "gram"]).select("set_id", "url", "pattern")
    loose = own.join(table.filter(F.col("gram").isNull()), "set_id").select("set_id", "url", "pattern")
    return indexed.unionByName(loose).mapInArrow(_try_batches, own.schema).distinct()


def filter_patterns(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows ``(set_id, url, ...)`` whose URL is allowed: a pattern of its set is found in it, or the set has none.

    A null set has no patterns. A null URL is found by none.
    """
    sets = table.select("set_id").distinct()
    free = rows.join(sets, "set_id", "left_anti")
    return rows.join(matching_urls(rows, table), ["set_id", "url"], "left_semi").unionByName(free).select(*rows.columns)
