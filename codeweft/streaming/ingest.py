"""The incremental index as a stream of snapshot files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut
from ..sources.store import IndexStore

SNAPSHOT = "repo string, head string, path string, content binary, seq long"


def newest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, heads) of the newest head of each repository: the one of greatest `seq`, then head. Rows
    of other heads are dropped; a missing seq is older than any."""
    order = F.struct(F.coalesce("seq", F.lit(-1)).alias("version"), "head")
    heads = rows.groupBy("repo").agg(F.max(order).alias("_o")).select("repo", "_o.head", "_o.version")
    return rows.join(heads.select("repo", "head"), ["repo", "head"], "left_semi"), heads


def follow_snapshots(spark: SparkSession, landing: str, store: IndexStore, make_model,
                     checkpoint: str):
    """Every landed batch of whole-repository snapshots refreshes its repositories.

    The index keeps the sequence number of each repository's head: of several heads in one batch the
    newest counts, and a head that comes after a newer one is passed over. A replayed batch finds the
    commit already recorded and changes nothing.
    """
    def apply(batch, _):
        rows, heads = newest(cut(batch.withColumn("sha", F.sha2("content", 256))))
        store.refresh(rows.drop("head", "seq"), cut(heads), make_model, partial=True)

    return (spark.readStream.schema(SNAPSHOT).parquet(landing).writeStream
            .option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(apply).start())
