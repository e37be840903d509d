"""Decision and ranking metrics over scored rows."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import date_of_ts
from .ordering import global_rank, running_totals

# Cuts are four-decimal numbers, so every cut is a whole number of these steps.
_STEPS = 10_000


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def prf(rows: DataFrame, flag: Column, label: str = "label") -> DataFrame:
    """precision, recall, f1 (four decimals) and how many rows were selected."""
    pos = F.col(label) == 1
    counts = rows.agg(F.count_if(pos & flag).alias("tp"), F.count_if(~pos & flag).alias("fp"),
                      F.count_if(pos & ~flag).alias("fn"))
    scored = counts.withColumn("p", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))) \
                   .withColumn("r", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.select(F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"),
                         F.round(_f1(F.col("p"), F.col("r")), 4).alias("f1"),
                         (F.col("tp") + F.col("fp")).alias("selected"))


def best_threshold(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, f1): the lowest four-decimal cut with the best rounded F1.

    Rows are summed per cut step before anything is ordered. A row's step is the greatest
    cut value not above its score, so what a cut selects is exact though scores are not
    rounded; only steps some score rounds to are cuts. Scores are probabilities or cosines,
    which leaves at most 20001 steps for the running sum.
    """
    s = F.col(score).cast("double")
    near = F.floor(s * _STEPS)
    step = F.when((near + 1) / F.lit(float(_STEPS)) <= s, near + 1) \
            .when(near / F.lit(float(_STEPS)) <= s, near).otherwise(near - 1)
    cut = F.round(F.round(s, 4) * _STEPS).cast("long")
    hit = F.col(label).cast("long")
    marks = rows.select(F.explode(F.array(
        F.struct(step.cast("long").alias("k"), hit.alias("tp"), F.lit(1).cast("long").alias("n"), F.lit(0).alias("c")),
        F.struct(cut.alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("c"))))
        .alias("m")).select("m.*")
    steps = marks.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"), F.max("c").alias("c"))
    above = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    everything = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cuts = (steps.withColumn("ctp", F.sum("tp").over(above)).withColumn("cn", F.sum("n").over(above))
            .withColumn("pos", F.sum("tp").over(everything)).where("c = 1")
            .withColumn("p", _ratio(F.col("ctp"), F.col("cn")))
            .withColumn("r", _ratio(F.col("ctp"), F.col("pos"))))
    best = (cuts.select((F.col("k") / F.lit(float(_STEPS))).alias("threshold"),
                        F.round(_f1(F.col("p"), F.col("r")), 4).alias("f1"))
            .orderBy(F.desc("f1"), "threshold").limit(1))
    return best.agg(F.coalesce(F.max("threshold"), F.lit(0.5)).alias("threshold"),
                    F.coalesce(F.max("f1"), F.lit(-1.0)).alias("f1"))


def average_precision(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Step-wise area under precision-recall; equal scores are one step."""
    curve = running_totals(rows.select(F.col(score).cast("double").alias("s"),
                                       F.col(label).cast("long").alias("tp"),
                                       F.lit(1).cast("long").alias("n")), "s", ["tp", "n"])
    return curve.agg(F.round(F.try_divide(
        F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")), F.sum("tp")), 4).alias("pr_auc"))


def _lists(rows: DataFrame) -> DataFrame:
    """Rows of queries with at least two candidates (a list is one query's k results)."""
    return rows.withColumn("_n", F.count("*").over(W.partitionBy("qid"))).where("_n >= 2")


def precision_at_k(rows: DataFrame, ks=(5, 10), score: str = "score") -> DataFrame:
    """Mean share of positives among the k best; equal scores keep search order (`rank`)."""
    w = W.partitionBy("qid").orderBy(F.desc(score), "rank")
    placed = _lists(rows).withColumn("_r", F.row_number().over(w))
    per_query = placed.groupBy("qid").agg(*[
        (F.sum(F.when(F.col("_r") <= k, F.col("label")).otherwise(0))
         / F.least(F.lit(k), F.max("_n"))).alias(f"p_at_{k}") for k in ks])
    return per_query.agg(*[F.round(F.avg(f"p_at_{k}"), 4).alias(f"p_at_{k}") for k in ks])


def ndcg_at_k(rows: DataFrame, ks=(5, 10), score: str = "score") -> DataFrame:
    """Mean NDCG; tied scores share the mean gain of the positions they occupy."""
    def discounts(upto: Column, k: int) -> Column:
        table = [0.0]
        for i in range(k):
            table.append(table[-1] + 1.0 / math.log2(i + 2))
        return F.element_at(F.array(*[F.lit(x) for x in table]),
                            (F.least(upto, F.lit(k)) + 1).cast("int"))

    ties = _lists(rows).groupBy("qid", F.col(score).alias("_s")).agg(
        F.count("*").alias("n"), F.sum("label").alias("gain"))
    w = W.partitionBy("qid").orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, 0)
    placed = ties.withColumn("end", F.sum("n").over(w)).withColumn("start", F.col("end") - F.col("n"))
    per_query = placed.groupBy("qid").agg(F.sum("gain").alias("pos"), *[
        F.sum(F.col("gain") / F.col("n") * (discounts(F.col("end"), k) - discounts(F.col("start"), k)))
        .alias(f"dcg_{k}") for k in ks])
    return per_query.agg(*[
        F.round(F.avg(_ratio(F.col(f"dcg_{k}"), discounts(F.col("pos"), k))), 4).alias(f"ndcg_at_{k}")
        for k in ks])


def time_split(groups: DataFrame, split: float = 0.8, minimum: int = 50) -> DataFrame:
    """train / valid / test by commit time: test is newest, valid the last 15 % of train."""
    n = groups.count()
    if n < minimum:
        raise ValueError(f"only {n} usable queries")
    cut = int(n * split)
    fit = int(cut * 0.85)
    ranked = global_rank(groups, "ts", "sha", name="_at")
    return ranked.withColumn("part", F.when(F.col("_at") < fit, "fit")
                             .when(F.col("_at") < cut, "valid").otherwise("test")).drop("_at")


def conditions(rows: DataFrame) -> DataFrame:
    """What a split holds. rows(qid, query_repo, ts, label): one per candidate."""
    return rows.agg(
        F.count_distinct("qid").alias("queries"), F.count_distinct("query_repo").alias("repos"),
        F.count("*").alias("candidates"), F.sum("label").cast("long").alias("positives"),
        F.round(_ratio(F.sum("label"), F.count("*")), 4).alias("positive_rate"),
        date_of_ts(F.min("ts")).alias("first_commit"), date_of_ts(F.max("ts")).alias("last_commit"))


def evaluate(train: DataFrame, test: DataFrame, score: str = "score",
             rank_by: str | None = None) -> dict:
    """Cut tuned on train, everything else measured on test."""
    thr = best_threshold(train, score).first()["threshold"]
    out = {"threshold": thr, **prf(test, F.col(score) >= thr).first().asDict(),
           **average_precision(test, score).first().asDict()}
    for table in (ndcg_at_k, precision_at_k):
        out.update(table(test, score=rank_by or score).first().asDict())
    return out


def baseline_scores(rows: DataFrame) -> DataFrame:
    """Score columns of the fixed rules a model has to beat."""
    return rows.withColumn("repo_and_cos", F.when(F.col("same_repo") > 0, F.col("cos")).otherwise(-1.0)) \
               .withColumn("repo_first", F.col("cos") + F.col("same_repo"))
