"""Ranks and running totals that never put one big group, or the whole table, in one task."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut, parallelism


def global_rank(df: DataFrame, *keys, name: str = "rank") -> DataFrame:
    """0-based dense position of every row in the order of `keys`.

    The rows are range-partitioned and sorted once and cut there, so the per-partition
    counts that shift the local positions always describe the same partitions. Only that
    count table (one row per partition) is broadcast.
    """
    n = parallelism(df.sparkSession)
    ordered = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                  .withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright("_pos", 33)
    sizes = ordered.groupBy(part.alias("_part")).count()
    before = sizes.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count"))
                          .alias("_before"))
    return (ordered.withColumn("_part", part)
            .join(F.broadcast(before), "_part")
            .withColumn(name, F.col("_before") + F.col("_pos").bitwiseAND((1 << 33) - 1))
            .drop("_pos", "_part", "_before"))


def rank_in_group(df: DataFrame, group: list[str], order: list[str],
                  name: str = "rank") -> DataFrame:
    """0-based position inside each group; a hot group stays spread over many tasks."""
    ranked = global_rank(df, *group, *order, name="_global")
    firsts = ranked.groupBy(*group).agg(F.min("_global").alias("_group_start"))
    return (ranked.join(firsts, group)
            .withColumn(name, F.col("_global") - F.col("_group_start"))
            .drop("_global", "_group_start"))


def running_totals(df: DataFrame, by: str, sums: list[str], descending: bool = True) -> DataFrame:
    """Inclusive running sums over the distinct numeric values of `by`.

    Rows are summed per value first; values are then cut into ranges at approximate
    quantiles, so a range holds a bounded share of them. Quantiles only place the
    boundaries: the totals are exact wherever those fall.
    """
    per_value = cut(df.groupBy(by).agg(*[F.sum(c).alias(c) for c in sums]))
    n = parallelism(df.sparkSession)
    edges = per_value.select(F.percentile_approx(
        by, [i / n for i in range(1, n)], 10_000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    if not edges:
        edges = [0.0]
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(by)))
    placed = per_value.withColumn("_bucket", bucket)
    order = F.desc if descending else F.asc
    totals = placed.groupBy("_bucket").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    seq = W.orderBy(order("_bucket"))
    shifted = totals.select("_bucket", *[(F.sum(f"_{c}").over(seq) - F.col(f"_{c}")).alias(f"_{c}")
                                         for c in sums])
    local = W.partitionBy("_bucket").orderBy(order(by)).rowsBetween(W.unboundedPreceding, 0)
    return (placed.join(F.broadcast(shifted), "_bucket")
            .select(by, *sums,
                    *[(F.sum(c).over(local) + F.col(f"_{c}")).alias(f"cum_{c}") for c in sums]))


def carry_forward(df: DataFrame, group: list[str], order: str, value: str, fold: str = "last",
                  block: int = 1 << 12) -> DataFrame:
    """`value` becomes its last non-null (or, with fold="max", its greatest) so far in `order`.

    `order` is an integer. Rows are handled in blocks of the order axis; one row per block
    carries the state from block to block, so a group of any length is many small windows.
    Rows of equal order see each other.
    """
    pick = (lambda: F.max_by(value, order)) if fold == "last" else (lambda: F.max(value))
    placed = df.withColumn("_blk", F.floor(F.col(order) / F.lit(float(block))))
    ends = (placed.where(F.col(value).isNotNull()).groupBy(*group, "_blk").agg(pick().alias("_end")))
    blocks = placed.select(*group, "_blk").distinct().join(ends, [*group, "_blk"], "left")
    before = W.partitionBy(*group).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    inside = (W.partitionBy(*group, "_blk").orderBy(order)
              .rangeBetween(W.unboundedPreceding, W.currentRow))
    state = F.last("_end", ignorenulls=True) if fold == "last" else F.max("_end")
    local = F.last(value, ignorenulls=True) if fold == "last" else F.max(value)
    merge = F.coalesce if fold == "last" else F.greatest
    carried = blocks.select(*group, "_blk", state.over(before).alias("_before"))
    return (placed.join(carried, [*group, "_blk"])
            .withColumn(value, merge(local.over(inside), F.col("_before"))).select(*df.columns))
