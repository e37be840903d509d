"""Training-corpus pipeline over `documents`: quality rules, near-duplicates, benchmark
decontamination, personal data, encoding. Every stage reads what its predecessor wrote."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codeweft.llm.decontaminate import decontamination_stage
from codeweft.llm.neardup import neardup_stage
from codeweft.llm.pieces import encoding_stage
from codeweft.llm.pii import pii_stage
from codeweft.llm.quality import quality_stage
from codeweft.session import ensure_checkpoint_dir

STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("encoding", encoding_stage),
]

# MinHash, surrogates and segmentation have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to `documents`; each result is written as Parquet in the shared folder and read
    again as the next stage's input."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
