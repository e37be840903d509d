"""SCIP indexes in their JSON form: one big object per repository, or one document a line."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators.scip import Flat, flatten_documents


def read_index(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Documents of a `print --json` file; `doc` is their order in it."""
    raw = spark.read.schema(schemas.SCIP_INDEX).json(path, multiLine=True)
    return raw.select(F.lit(repo).alias("repo"), F.posexplode("documents").alias("doc", "d")) \
              .select("repo", "doc", "d.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Splittable form: one JSON document a line with its repo and position."""
    return spark.read.schema(f"repo string, doc int, {schemas.SCIP_DOCUMENT}").json(path)


def tool_name(spark: SparkSession, path: str) -> str:
    raw = spark.read.schema(schemas.SCIP_INDEX).json(path, multiLine=True)
    row = raw.select("metadata.tool_info.name").first()
    return (row[0] if row else "") or ""


def load(spark: SparkSession, path: str, repo: str) -> Flat:
    return flatten_documents(read_index(spark, path, repo))
