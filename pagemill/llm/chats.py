"""Logged conversations that are prefixes of longer ones collapse into those; the rest is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import running_total
from ..storage import Workspace
from .common import boxed


def turn_text(role: str | Column, text: str | Column) -> Column:
    """One turn as rendered: a role line, the text, an end line. Null role: ``unknown``; null text: empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"),
                    F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def prefix_hashes(turns: DataFrame, ws: Workspace, conv_id: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """``(row, conv_id, pos, role, text, PREFIX)``: every turn with its 0-based place in its
    conversation and a hash of the conversation up to and including it.

    A turn's own two 64-bit hashes cover its place, role and text; a prefix's hash is their running
    sum (in halves of 32 bits, which no sum overflows), so long conversations are summed piece by
    piece over range partitions and never gathered. Turns are ordered by ``turn`` (null first),
    then role and text, so ties have one order.
    """
    own = boxed(turns, conv_id=conv_id, turn=turn, role=role, text=text)
    placed = ws.put(running_total(own, ["conv_id"], ["turn", "role", "text"], None, "pos", ws), "placed")
    low = F.lit(0xFFFFFFFF).cast("long")
    for k, seed in (("m1", 5), ("m2", 17)):
        mark = F.xxhash64(F.lit(seed), F.isnull("role"), "role", F.isnull("text"), "text", "pos")
        placed = placed.withColumn(f"{k}hi", F.shiftright(mark, 32)).withColumn(f"{k}lo", mark.bitwiseAND(low))
    return ws.put(prefix_sums(placed, PREFIX[1:]), "prefixes")


def prefix_sums(placed: DataFrame, names: list[str], run: int = 4096) -> DataFrame:
    """Running sums of ``names`` along ``pos`` of a conversation, in runs of ``run`` turns.

    A conversation longer than a run is several groups; sums of earlier runs, one row per run, are
    added to the few that need them.
    """
    cut = placed.withColumn("run", F.floor(F.col("pos") / run))
    inside = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut.groupBy("conv_id", "run").agg(*[F.sum(n).alias(n) for n in names]).select(
        F.col("conv_id").alias("c"), F.col("run").alias("r"), *[F.sum(n).over(before).alias(f"b_{n}") for n in names])
    own = cut.select("row", "conv_id", "run", "pos", "role", "text", *[F.sum(n).over(inside).alias(n) for n in names])
    met = own.join(runs.filter("r > 0"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")), "left")
    return met.select("row", "conv_id", "pos", "role", "text", *[
        (F.col(n) + F.coalesce(f"b_{n}", F.lit(0).cast("long"))).alias(n) for n in names])


PREFIX = ["pos", "m1hi", "m1lo", "m2hi", "m2lo"]


def collapse_snapshots(turns: DataFrame, ws: Workspace, **columns: str) -> DataFrame:
    """The turns ``(row, conv_id, pos, n_turns, role, text)`` of maximal conversations.

    A conversation is dropped if its turns (role and text, in order) are the first turns of a longer
    one, or equal those of one with a smaller ``conv_id``. Turns with a null ``conv_id`` are one
    conversation, which stays only where no equal one has an id. Repeated turn rows are turns. Empty and very long texts
    and null roles and texts are compared like others. An empty table gives an empty one.

    Equal conversations become one row before they meet the prefixes, and prefixes are distinct
    before the anti-join, so a first turn or a conversation that a third of the log repeats is one
    row on each side.
    """
    rows = prefix_hashes(turns, ws, **columns)
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*PREFIX)).alias("end"))
    whole = last.groupBy(*[F.col(f"end.{p}").alias(p) for p in PREFIX]).agg(
        F.min(F.struct(F.isnull("conv_id").alias("unnamed"), "conv_id")).alias("first"))
    ends = last.select(F.col("conv_id").alias("c"), F.col("end.pos").alias("last"))
    inner = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).filter("pos < last").select(*PREFIX).distinct()
    kept = ws.put(whole.join(inner, PREFIX, "left_anti").select(
        F.col("first.conv_id").alias("c"), (F.col("pos") + 1).alias("n_turns")), "kept")
    met = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
    return met.select("row", "conv_id", "pos", "n_turns", "role", "text")


def rendered(collapsed: DataFrame) -> DataFrame:
    """``(conv_id, pos, n_turns, rendered)``: a conversation's text is its rendered turns in order.

    One row per turn, so that no conversation has to fit into one value."""
    return collapsed.select("conv_id", "pos", "n_turns", turn_text("role", "text").alias("rendered"))


def op5(spark, folder: str) -> DataFrame:
    """conv_id, pos, n_turns and rendered text of every turn of every maximal conversation."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    return rendered(collapse_snapshots(turns, Workspace(spark)))


SQL = r"""WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations),
prefixes AS (SELECT *, string_agg(md5(role || chr(0) || text), '' ORDER BY pos) OVER
               (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix FROM placed),
whole AS (SELECT prefix, min(conv_id) AS conv_id FROM prefixes WHERE pos = n_turns - 1 GROUP BY prefix),
kept AS (SELECT w.conv_id FROM whole w ANTI JOIN (SELECT DISTINCT prefix FROM prefixes WHERE pos < n_turns - 1) p
           ON w.prefix = p.prefix)
SELECT p.conv_id, p.pos, p.n_turns, '<|' || p.role || '|>' || chr(10) || p.text || chr(10) || '<|end|>' || chr(10) AS rendered
FROM placed p JOIN kept k ON p.conv_id = k.conv_id"""
