"""Intermediate tables in the shared folder that the cluster names.

A written table cuts lineage, survives the loss of any executor, and gives Catalyst true
sizes, so small inputs of later joins are broadcast by measured size only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a scratch folder only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="pagemill-")


class Workspace:
    """A fresh folder for one run; tables in it are written once and read back."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/pagemill-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
        """Store a table. Rows that cost much and take few bytes go into files of few rows, as Spark deals
        out bytes and files, not rows, to the tasks that read them."""
        target = f"{self.path}/{name}"
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def put_bucketed(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """A table hashed by ``keys`` once, so that later joins on them move only their other side.

        A second call with the same name adds rows. The files lie in this workspace; only the
        session's own catalog knows the table.
        """
        table = f"{self.path.rsplit('/', 1)[1].replace('-', '_')}_{name}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        columns = [F.col(k) for k in keys]
        (df.repartition(n, *columns).write.bucketBy(n, *keys).option("path", f"{self.path}/{name}")
         .mode("append").format("parquet").saveAsTable(table))
        return self.spark.table(table)

    def get(self, like: DataFrame, names: list[str]) -> DataFrame:
        """Several tables of one schema as a single scan."""
        return self.spark.read.schema(like.schema).parquet(*[f"{self.path}/{n}" for n in names])
