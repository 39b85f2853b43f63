"""Running sums and ranks over whole groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace


def running_total(df: DataFrame, groups: list[str], order: list[str], amount: Column | None = None,
                  out: str = "before", workspace: Workspace | None = None) -> DataFrame:
    """Add ``out``: the sum of ``amount`` (1 per row by default) over earlier rows of the group.

    The rows are range-partitioned by group and order, so a group that holds a large share of all
    rows spreads over many partitions. The partitioned rows are written once, which fixes the
    partition of every row. Sums then run inside a partition, and the partition totals (at most
    groups + partitions rows) give each partition its starting value.
    """
    spark = df.sparkSession
    ws = workspace or Workspace(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id()).withColumn(
        "_amount", (F.lit(1) if amount is None else amount).cast("long"))
    parted = ws.put(
        tied.repartitionByRange(n, *groups, *order, "_tie").withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part", *groups).orderBy(*order, "_tie").rowsBetween(
        Window.unboundedPreceding, -1)
    across = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("_part", *groups).agg(F.sum("_amount").alias("_sum")).select(
        "_part", *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_start"))
    local = parted.withColumn("_local", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    same = local["_part"] == starts["_part"]
    for g in groups:
        same = same & local[g].eqNullSafe(starts[f"_g_{g}"])
    return local.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_local")).alias(out))


def group_rank(df: DataFrame, groups: list[str], order: list[str], out: str = "rank",
               workspace: Workspace | None = None) -> DataFrame:
    """0-based position of each row in its group.

    Rows are written before they are ranked: choosing the ranges looks at all of them twice, and
    what made them (a parse, a join) should run once.
    """
    ws = workspace or Workspace(df.sparkSession)
    plain = df.toDF(*[f"_r{i}" for i in range(len(df.columns))])
    stored = ws.put(plain, "ranked").toDF(*df.columns)
    return running_total(stored, groups, order, None, out, ws)
