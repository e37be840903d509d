"""Ranking data mined from commit history, and the added lines of a change."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions import text as T
from .ordering import carry_forward


def collect_queries(commits: DataFrame, changes: DataFrame, since: int = 0, until: int | None = None,
                    max_files: int | None = None, min_chars: int = 1) -> DataFrame:
    """commits(repo, sha, ts, subject, merge), changes(repo, sha, status, path)
    -> (repo, sha, ts, query, files), one per usable commit.

    `max_files` leaves out commits that touch more files, by count before any list is built;
    `min_chars` leaves out shorter subjects. Both are off by default, and a list then is as long as
    its commit.
    """
    window = F.col("ts") >= since
    if until is not None:
        window &= F.col("ts") <= until
    wanted = (commits.where(window & ~F.coalesce(F.col("merge"), F.lit(False)))
              .withColumn("query", T.clean_query(F.col("subject"), min_chars)).where("query IS NOT NULL")
              .select("repo", "sha", "ts", "query"))
    files = changes.where(T.indexable_change(F.col("status"), F.col("path"))) \
                   .select("repo", "sha", "path")
    if max_files is not None:
        narrow = files.groupBy("repo", "sha").count().where(F.col("count") <= max_files)
        files = files.join(narrow, ["repo", "sha"], "left_semi")
    lists = (files.groupBy("repo", "sha")
             .agg(F.sort_array(F.collect_list("path")).alias("files")))
    return wanted.join(lists, ["repo", "sha"])


def touched_files(queries: DataFrame) -> DataFrame:
    return queries.select(F.concat_ws("@", "repo", "sha").alias("qid"), F.explode(
        F.transform("files", lambda f: T.file_key(F.col("repo"), f))).alias("file"))


def build_groups(queries: DataFrame, labelled: DataFrame) -> DataFrame:
    """Query groups with their (at most k) labelled candidates in search order."""
    item = F.struct("distance", "id", "repo", "path", "start_line", "end_line", "symbol",
                    "lang", "text_len", "label")
    lists = (labelled.select("qid", item.alias("c")).groupBy("qid")
             .agg(F.sort_array(F.collect_list("c")).alias("c")))
    final = F.transform("c", lambda c: F.struct(
        c["repo"].alias("repo"), c["path"].alias("path"), c["start_line"].alias("start_line"),
        c["end_line"].alias("end_line"), F.coalesce(c["symbol"], F.lit("")).alias("symbol"),
        c["lang"].alias("lang"), c["text_len"].alias("text_len"),
        c["distance"].alias("distance"), c["label"].alias("label")))
    return (queries.withColumn("qid", F.concat_ws("@", "repo", "sha")).join(lists, "qid")
            .select("repo", "sha", "ts", "query",
                    F.aggregate("c", F.lit(0), lambda a, c: a + c["label"]).alias("n_pos"),
                    final.alias("candidates")))


def explode_groups(groups: DataFrame, require_positive: bool = True, *keep: str) -> DataFrame:
    """Stored groups back to one row per candidate with the query's own tokens and repo."""
    used = groups.where("n_pos > 0") if require_positive else groups
    return (used.select(F.concat_ws("@", "repo", "sha").alias("qid"), F.col("repo").alias("query_repo"),
                        "sha", "ts", *keep, T.tokens(F.col("query")).alias("query_tokens"),
                        F.posexplode("candidates").alias("id", "c"))
            .select("qid", "query_repo", "sha", "ts", *keep, "query_tokens", "id", "c.*"))


def added_ranges(diff: DataFrame) -> DataFrame:
    """diff(change, line_no, line): unified diff without context -> added (path, first, last).

    A hunk belongs to the last file header above it, in the order of one change's lines.
    """
    header = F.regexp_extract("line", r"^\+\+\+ b/(.*)$", 1)
    is_header = F.col("line").startswith("+++ ")
    path = F.when(F.col("line").startswith("+++ b/"), header).when(is_header, F.lit(""))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    marks = diff.where(is_header | F.col("line").rlike(hunk)).withColumn("path", path)
    count = F.when(F.regexp_extract("line", hunk, 2) == "", F.lit(1)) \
             .otherwise(F.expr("try_cast(regexp_extract(line, '" + hunk.replace("\\", "\\\\") + "', 2) AS int)"))
    return (carry_forward(marks, ["change"], "line_no", "path")
            .where(~is_header & (F.coalesce("path", F.lit("")) != ""))
            .withColumn("first", F.regexp_extract("line", hunk, 1).cast("int"))
            .withColumn("n", count).where("n > 0")
            .select("change", "path", "first", (F.col("first") + F.col("n") - 1).alias("last")))


def changed_chunks(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunks of the changed files that overlap any added range.

    chunks and ranges share (change, path). A chunk is hit when, among the ranges that start
    no later than its last line, the greatest end reaches its first line: chunks and ranges
    are merged by position instead of being paired.
    """
    item = F.struct(*chunks.columns)
    no_item = F.lit(None).cast(chunks.select(item).schema[0].dataType)
    marks = ranges.select("change", "path", F.col("first").alias("_at"), F.col("last").alias("_reach"),
                          no_item.alias("_c"))
    probes = chunks.select("change", "path", F.col("end_line").alias("_at"),
                           F.lit(None).cast("int").alias("_reach"), item.alias("_c"))
    merged = carry_forward(marks.unionByName(probes), ["change", "path"], "_at", "_reach", "max")
    return merged.where(F.col("_c").isNotNull() & (F.col("_reach") >= F.col("_c.start_line"))).select("_c.*")
