"""Group-relative feature rows of (query, candidate) pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..constants import FEATURES
from ..functions import text as T
from ..functions.vectors import cos_from_distance


def group_features(candidates: DataFrame) -> DataFrame:
    """candidates(qid, query_tokens, query_repo, id, repo, path, symbol, lang, text_len,
    distance, ...) -> the same rows plus the fifteen features in contract order.

    A group is one query's result list (k rows), so all windows share one exchange on qid;
    the file window is finer than it and needs no exchange of its own.
    """
    group = W.partitionBy("qid")
    ordered = group.orderBy("distance", "id")
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    in_file = W.partitionBy("qid", "file")
    symbol = F.coalesce(F.col("symbol"), F.lit(""))

    def flag(cond):
        return F.when(cond, 1.0).otherwise(0.0)

    # What a row says about itself comes first, so token arrays never reach the windows.
    own = (candidates.withColumn("cos", cos_from_distance(F.col("distance")))
           .withColumn("file", T.file_key(F.col("repo"), F.col("path")))
           .withColumn("same_repo", flag((F.col("query_repo") != "")
                                         & (F.col("repo") == F.col("query_repo"))))
           .withColumn("path_depth", F.size(F.split("path", "/", -1)).cast("double"))
           .withColumn("_path", T.tokens(F.col("path"))).withColumn("_symbol", T.tokens(symbol))
           .withColumn("path_overlap", T.overlap(F.col("query_tokens"), F.col("_path")))
           .withColumn("symbol_overlap", T.overlap(F.col("query_tokens"), F.col("_symbol")))
           .withColumn("has_symbol", flag(symbol != ""))
           .withColumn("log_text_len", F.log1p("text_len"))
           .withColumn("is_code_lang", flag(T.is_code_lang(F.col("lang"))))
           .withColumn("is_excluded_path", flag(T.excluded_path(F.col("file")))))
    return (own.withColumn("rank", (F.row_number().over(ordered) - 1).cast("double"))
            .withColumn("cos_top1", F.first("cos").over(whole))
            .withColumn("_mean", F.avg("cos").over(group))
            .withColumn("_std", F.stddev_pop("cos").over(group))
            .withColumn("same_file_frac", F.count("*").over(in_file) / F.count("*").over(group))
            .withColumn("cos_gap_top", F.col("cos_top1") - F.col("cos"))
            .withColumn("cos_z", F.when(F.col("_std") > 1e-9,
                                        (F.col("cos") - F.col("_mean")) / F.col("_std")).otherwise(0.0))
            .select(*[c for c in candidates.columns if c not in FEATURES or c == "distance"],
                    *[F.col(f) for f in FEATURES if f != "distance"]))


def label(candidates: DataFrame, touched: DataFrame) -> DataFrame:
    """label 1 where the candidate's file was changed by the query's commit.

    touched(qid, file); candidates(qid, repo, path, ...).
    """
    marks = touched.select("qid", F.col("file").alias("_file")).distinct() \
                   .withColumn("_hit", F.lit(1))
    keyed = candidates.withColumn("_file", T.file_key(F.col("repo"), F.col("path")))
    return (keyed.join(marks, ["qid", "_file"], "left")
            .withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit", "_file"))
