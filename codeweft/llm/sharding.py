"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in source parts that their id decides. How many rows of each part go to each shard is
drawn at once, as a uniform permutation would have it (a table with fixed margins). Each part
then permutes its rows by itself and deals them out by those counts, rows are exchanged, and
every shard permutes again. All draws and orders follow from a seed and the rows, so a task
that runs twice does the same."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .text import fresh

ROWS_PER_BLOCK = 100_000        # rows ordered in one task


def _key(seed: int, salt: str, ids: list[str]) -> Column:
    return F.xxhash64(F.lit(f"{salt}:{seed}"), *ids)


SMALL = 10**9 - 1               # numpy draws from populations below this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of `n` draws without replacement are good, for counts of any size.

    All items lie at uniform places and the n lowest are drawn. The place of the middle good item is
    a beta variable, the number of bad ones below it a binomial; either all of these are drawn or
    only items below it are, and what is left is the same question with half the good items."""
    drawn = 0
    while n and good and good + bad >= SMALL:
        middle = (good + 1) // 2
        below = int(rng.binomial(bad, rng.beta(middle, good - middle + 1)))
        if middle + below <= n:
            drawn, good, bad, n = drawn + middle, good - middle, bad - below, n - middle - below
        else:
            good, bad = middle - 1, below
    return drawn + (int(rng.hypergeometric(good, bad, n)) if n and good else 0)


def _dealt(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of `n` draws come from each of the classes of sizes `left`: halves of the classes, then
    halves of these."""
    if len(left) == 1:
        return np.array([n], np.int64)
    half = len(left) // 2
    first, second = left[:half], left[half:]
    k = hypergeometric(rng, int(first.sum()), int(second.sum()), n)
    return np.concatenate((_dealt(rng, first, k), _dealt(rng, second, n - k)))


def communication_matrix(part_sizes, shards: int, seed: int) -> np.ndarray:
    """Counts (part, shard) of a uniform permutation: rows sum to the part sizes, columns to shard
    sizes that differ by one at most. One multivariate hypergeometric draw per part."""
    total = int(sum(part_sizes))
    left = np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(part_sizes), shards), np.int64)
    for i, n in enumerate(part_sizes):
        out[i] = (rng.multivariate_hypergeometric(left, int(n), method="marginals") if left.sum() < SMALL
                  else _dealt(rng, left, int(n)))
        left -= out[i]
    return out


def shuffle_to_shards(rows: DataFrame, ids: list[str], shards: int, seed: int = 0) -> DataFrame:
    """`rows` plus `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    Columns of these names are replaced. `ids` should tell rows apart; rows equal in all of them are interchangeable, so which of them
    gets which place has no meaning. Null ids are an id like any other. Shard sizes differ by one
    at most; fewer rows than shards leave some shards empty; an empty table gives an empty result.
    Parts and blocks hold about ROWS_PER_BLOCK rows however large the table is; the driver holds
    one count for each part and shard."""
    part, key, rank, block, base = fresh(rows.columns, "part", "key", "rank", "block", "base")
    n = rows.count()
    parts = max(1, -(-n // ROWS_PER_BLOCK))
    blocks = max(1, -(-n // (shards * ROWS_PER_BLOCK)))
    dealt = rows.withColumn(part, F.pmod(_key(seed, "part", ids), F.lit(parts)).cast("int"))
    sizes = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    matrix = communication_matrix([sizes.get(i, 0) for i in range(parts)], shards, seed)
    spark = rows.sparkSession
    ends = spark.createDataFrame([(i, e) for i, e in enumerate(matrix.cumsum(axis=1).tolist())],
                                 f"`{part}` int, `{base}` array<bigint>")
    # first permutation: the order inside a part, cut by the part's counts
    order = Window.partitionBy(part).orderBy(_key(seed, "first", ids), *ids)
    placed = (dealt.withColumn(rank, F.row_number().over(order)).join(ends, part)
              .withColumn("shard", F.size(F.filter(base, lambda e: e < F.col(rank))).cast("int"))
              .drop(base, rank, part))
    # second permutation: by a new random key, in blocks of consecutive keys
    top = F.floor(F.shiftrightunsigned(F.col(key), 11) / float(1 << 53) * blocks)
    placed = placed.withColumn(key, _key(seed, "second", [*ids, "shard"])).withColumn(
        block, F.least(top, F.lit(blocks - 1)).cast("int"))
    placed = cut(placed)
    counts = placed.groupBy("shard", block).agg(F.count("*").alias(base))
    before = counts.withColumn(base, F.sum(base).over(
        Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy("shard", block).orderBy(key, *ids)
    return (placed.withColumn(rank, F.row_number().over(inner)).join(before, ["shard", block])
            .withColumn("slot", (F.coalesce(base, F.lit(0)) + F.col(rank) - 1).cast("long"))
            .drop(key, block, rank, base))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order inside its files."""
    (shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def op10(spark, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = cut(rows)             # two passes over three narrow columns, not over the texts
    out = shuffle_to_shards(rows, ["doc_id", "text_crc32", "size"], 24, seed=20)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
