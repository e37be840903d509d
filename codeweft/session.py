"""Session defaults and the rules every operator shares: where lineage is cut and how an
input is spread."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "codeweft", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        b = b.config(key, value)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="codeweft-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once below the shared checkpoint folder and go on from that table.

    A written table survives lost executors like a checkpoint does, and later steps read
    only the columns they need, with known sizes. It is dropped when the session ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame, rows: int | None = None) -> DataFrame:
    """Use every core on an input of few files. `scan` is a bare read: asking for its
    partitions runs nothing, and an input with enough of them is left as it is. With `rows`, for heavy work
    on narrow rows, a task gets no more than about so many however few bytes they are."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    if rows:
        return scan.repartition(max(n, -(-scan.count() // rows)))
    return scan if scan.rdd.getNumPartitions() >= n // 2 else scan.repartition(n)
