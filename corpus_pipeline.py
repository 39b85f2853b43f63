"""Raw documents to token digests, in five stages.

Each stage takes ``(spark, docs, folder)`` and returns the next stage's documents; ``run`` writes
every stage's rows and reads them back, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import line_dedup, mixing, pieces, quality, simhash
from pagemill.storage import Workspace

STAGES = [
    ("quality rules", quality.stage),
    ("line dedup", line_dedup.stage),
    ("simhash near-dedup", simhash.stage),
    ("source mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]

#: The rules of the first stage are learned from labels, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table: doc_id, n_tokens, ids_sha256, decoded_sha256
    of every row of the mix."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for step, (_, stage) in enumerate(STAGES):
        docs = ws.put(stage(spark, docs, sf_dir), f"stage_{step}")
    return docs
