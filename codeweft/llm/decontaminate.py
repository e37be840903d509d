"""Benchmark decontamination: short test items inside long documents, in DataFrame functions only.

MinHash containment search: permutation j of an item picks one of its shingles, the one of least
hash; a document that contains a share c of the item holds that shingle with probability c.
Documents are partitioned by the number of their shingles. Each class asks for its own number of
picks and of hits among them, so that an item at the threshold is missed with probability
`miss` at most, while long documents, which meet single shingles by chance, need more hits.
Candidates are verified by exact containment of full shingle sets.

Neither side is broadcast by hand: Spark does so below its own size threshold and otherwise
joins by hash. Hits are counted with partial sums, so one item in a third of all documents
is no hot task."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .text import gram_hashes, words

# Upper ends of the document classes (shingles), and the hits that each asks for.
CLASSES = ((1 << 10, 1), (1 << 14, 2), (None, 3))


def picks_needed(threshold: float, hits: int, miss: float) -> int:
    """Least number of picks with P(fewer than `hits` hits) <= miss at the threshold."""
    k = hits
    while sum(math.comb(k, i) * threshold ** i * (1 - threshold) ** (k - i) for i in range(hits)) > miss:
        k += 1
    return k


def _grams(text: Column, k: int, short: list[int], fold: bool) -> Column:
    w = words(F.lower(text) if fold else text)
    # words are bound once by a one-element transform
    return F.get(F.transform(F.array(w), lambda x: F.array_distinct(
        F.concat(gram_hashes(x, k), *[gram_hashes(x, n) for n in short]))), 0)


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, miss: float = 1e-6,
                    fold_case: bool = True) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) for each document that holds at least `threshold` of
    an item's distinct k-word shingles. An item of fewer words is one shingle: all its words.
    Words are compared in lower case, that of all letters, unless `fold_case` is off.

    Null or empty texts and items match nothing. A repeated (doc_id, text) or (item_id, text) row
    counts once. Other columns are not read. Empty tables give no rows."""
    docs = docs.select("doc_id", "text").where("text is not null").withColumn("row", F.xxhash64("doc_id", "text"))
    w = words(F.lower("text") if fold_case else F.col("text"))
    items = cut(items.select("item_id", "text").where("text is not null").distinct().withColumn("w", w)
                .where("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(k)))
                .withColumn("item", F.xxhash64("item_id", "text")))
    short = sorted(r.n for r in items.select("n").distinct().collect() if r.n < k)   # k - 1 numbers at most
    own = F.coalesce(*[F.when(F.col("n") == n, gram_hashes(F.col("w"), n)) for n in [*short, k]])
    sets = cut(items.select("item_id", "item", F.array_distinct(own).alias("set")))

    hits = [h for _, h in CLASSES]
    picks = {h: picks_needed(threshold, h, miss) for h in hits}
    # a lambda's second parameter, default or not, would be the place in the array, the same for all picks
    pick = lambda j: F.array_min(F.transform("set", lambda s: F.struct(F.xxhash64(s, F.lit(j)).alias("r"), s.alias("s"))))["s"]
    chosen = F.array(*[pick(j) for j in range(max(picks.values()))])
    anchors = sets.select("item", F.posexplode(chosen).alias("pick", "gram"))
    size = F.size("grams")
    level = lambda of: F.coalesce(*[F.when(size < end, F.lit(of[h])) for end, h in CLASSES if end],
                                  F.lit(of[CLASSES[-1][1]]))
    grams = docs.select("row", "doc_id", _grams(F.col("text"), k, short, fold_case).alias("grams"))
    exploded = grams.select("row", "doc_id", level(picks).alias("picks"), level({h: h for h in hits}).alias("hits"),
                            F.explode("grams").alias("gram"))
    found = (exploded.join(anchors, "gram").where("pick < picks")
             .groupBy("row", "doc_id", "item", "hits").agg(F.count_distinct("pick").alias("n")).where("n >= hits")
             .select("row", "item"))
    found = cut(found)
    # exact: all shingles of the candidate documents against all shingles of their candidate items
    again = (docs.join(found.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
             .select("row", "doc_id", F.explode(_grams(F.col("text"), k, short, fold_case)).alias("gram")))
    wanted = found.join(sets, "item").select("row", "item", "item_id", F.size("set").alias("n_shingles"),
                                             F.explode("set").alias("gram"))
    return (again.join(wanted, ["row", "gram"]).groupBy("row", "item", "doc_id", "item_id", "n_shingles")
            .agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= threshold * F.col("n_shingles"))
            .select("doc_id", "item_id", F.col("n_shingles").cast("long"), "n_shared"))


def op7(spark, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                           spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go, all rows with their doc_id. Null and empty
    texts hold nothing and stay; a null doc_id is an id like any other."""
    bad = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")


OP7_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
           FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, least(len(w), 5) AS k, unnest(list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2),
             lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' ')))) AS g FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
      FROM w, (SELECT DISTINCT k FROM s) WHERE len(w) >= k)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared
FROM s JOIN d USING (k, g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles"""
