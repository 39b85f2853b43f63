"""Lines that many documents share are dropped, except from the last document that holds them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import boxed, row_key, ship, slices, unboxed

ship(__name__)
BLANK = " \t\n\x0b\x0c\r"
LINES = "doc_id long, k1 long, k2 long, pos int, h1 long, h2 long"


def line_keys(least: int):
    """The Arrow stage: one row per line whose key has at least ``least`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in LINES.split(", ")]
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                lines = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
                parent = pc.list_parent_indices(lines)
                first = lines.offsets.to_numpy()[:-1] - lines.offsets[0].as_py()
                flat = pc.list_flatten(lines)
                keys = pc.ascii_lower(pc.utf8_trim(flat, BLANK))
                long = pc.greater_equal(pc.utf8_length(keys), least)
                at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
                owner = parent.to_numpy()[at]
                digests = b"".join([xxhash.xxh3_128_digest(k) for k in keys.filter(long).to_pylist()])
                h = np.frombuffer(digests, np.int64).reshape(-1, 2)
                own = batch.select(["doc_id", "k1", "k2"]).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array((at - first[owner]).astype(np.int32)),
                     pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=names)

    return run


def drop_common_lines(docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text",
                      least: int = 40, documents: int = 5) -> DataFrame:
    """``(row, doc_id, kept, n_lines, n_dropped)`` for every row of ``docs``.

    A text is split at ``\\n``; the key of a line is the line without blanks at its ends, A-Z
    lower-cased. Keys of at least ``least`` code points in at least ``documents`` distinct
    documents lose all their lines, except in the largest ``doc_id`` holding the key.

    A null or empty text is one empty line. A null ``doc_id`` counts as no document and is never
    the largest, so its rows lose every common line. Rows that repeat a ``doc_id`` count as one
    document. Repeated rows get the same result each. An empty table gives an empty one.

    The lines with long keys become a narrow table of hashes (written once, used for counting and
    for dropping). Counting combines by document first, then by key, so a line of very many
    documents is summed on the map side; dropping joins with one row per common key, which adaptive
    execution splits where a key is hot. Texts move once, to meet their dropped positions.
    """
    keyed = boxed(docs, doc_id=doc_id, text=text).withColumns(
        dict(zip(("k1", "k2"), row_key("doc_id", "text"), strict=True)))
    lines = ws.put(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "k1", "k2")
                   .mapInArrow(line_keys(least), LINES), "lines")
    common = ws.put(
        lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last"))
        .filter(F.col("n") >= documents).drop("n"), "common")     # a table, so that the join has its own shuffles
    dropped = (lines.join(common, ["h1", "h2"]).filter("doc_id IS NULL OR doc_id <> last")
               .groupBy("k1", "k2").agg(F.collect_set("pos").alias("dropped")))
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    joined = keyed.join(dropped, ["k1", "k2"], "left").withColumn("lines", split)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    return joined.select(
        "row", "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n")).alias("kept"))


def op3(spark, folder: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    done = drop_common_lines(docs, Workspace(spark))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The pipeline's stage: the same documents without their common lines; no document goes."""
    return unboxed(drop_common_lines(docs, Workspace(spark)), docs.columns, text="kept")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""WITH lines AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM documents d, unnest(string_split(coalesce(d.text, ''), chr(10))) WITH ORDINALITY AS u(line, pos)),
common AS (SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 40
           GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AND c.last_doc <> l.doc_id AS gone
           FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
