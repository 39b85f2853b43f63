"""Lookups of one row per key for many rows, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_lookup(rows: DataFrame, table: DataFrame, key: str, spread_by: str, salts: int | None = None, large: bool = False) -> DataFrame:
    """Left join of ``rows`` with ``table``, which holds at most one row per ``key``.

    ``salts`` is a quarter of the shuffle partitions (8 at least) unless given, so a hot key spreads
    further on a larger cluster. The rows of a key are spread over ``salts`` join keys by a hash of ``spread_by`` and the table
    row is repeated for each. The salt also keeps the join apart from an aggregation that made the
    table unique: sharing that aggregation's shuffle would stop adaptive execution from splitting
    what is still too large. A ``large`` table is shuffled however small its files are: Spark measures
    them before the rows are repeated.
    """
    salts = salts or max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if large:
        repeated = repeated.hint("merge")
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")
