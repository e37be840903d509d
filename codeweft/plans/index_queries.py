"""Incremental upkeep, parts and caches."""
from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import upkeep as U
from ..session import ensure_checkpoint_dir
from ..sources.store import IndexStore
from . import views as V


def _snapshot(spark, sf, until=None):
    """Last event of every (user, type): the files of a repository as of one moment."""
    e = V.events(spark, sf)
    if until is not None:
        e = e.where(F.col("ts") <= F.lit(until))
    last = U.upsert_latest(e.select("user_id", "event_type", "ts", "event_id", "value"),
                           ["user_id", "event_type"], F.struct("ts", "event_id"))
    live = last.where(F.col("value") > 5)     # a small last value stands for a deleted file
    return live.select(F.format_string("org/u%d", "user_id").alias("repo"),
                       F.concat("event_type", F.lit(".rs")).alias("path"),
                       F.col("event_id").cast("string").alias("sha"))


_SNAPSHOTS = f"""snap AS (
  SELECT ts <= {V.MIDYEAR_SQL} AS early, * FROM events),
late_s AS (
  SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
early_s AS (
  SELECT * FROM snap WHERE early
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
new_files AS (SELECT 'org/u' || user_id AS repo, event_type || '.rs' AS path, event_id::VARCHAR AS sha FROM late_s WHERE value > 5),
old_files AS (SELECT 'org/u' || user_id AS repo, event_type || '.rs' AS path, event_id::VARCHAR AS sha FROM early_s WHERE value > 5),
changed AS (
  SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.path, o.path) AS path,
         CASE WHEN o.sha IS NULL THEN 'A' WHEN n.sha IS NULL THEN 'D' ELSE 'M' END AS status
  FROM new_files n FULL JOIN old_files o ON o.repo = n.repo AND o.path = n.path
  WHERE n.sha IS DISTINCT FROM o.sha)"""


def upsert_latest(spark, sf):
    return U.upsert_latest(V.events(spark, sf).select("user_id", "event_type", "ts", "event_id", "value"),
                           ["user_id", "event_type"], F.struct("ts", "event_id")) \
        .select("user_id", "event_type", "event_id", "value")


def changeset_diff(spark, sf):
    return U.change_set(_snapshot(spark, sf, V.midpoint(spark, sf)), _snapshot(spark, sf))


def apply_changes(spark, sf):
    old, new = _snapshot(spark, sf, V.midpoint(spark, sf)), _snapshot(spark, sf)
    changed = U.change_set(old, new)
    fresh = new.join(changed.where("status <> 'D'"), ["repo", "path"], "left_semi")
    return U.apply_changes(old, changed, fresh.select(*old.columns))


def _stored(spark, sf):
    o = V.table(spark, sf, "orders").where("o_orderdate < '1998-01-01'")
    return U.upsert_latest(o.select(F.format_string("org/c%d", "o_custkey").alias("repo"),
                                    F.col("o_orderstatus").alias("commit_sha"), "o_orderkey"), ["repo"], "o_orderkey")


def _heads(spark, sf):
    o = V.table(spark, sf, "orders").where("o_orderdate >= '1997-01-01'")
    return U.upsert_latest(o.select(F.format_string("org/c%d", "o_custkey").alias("repo"),
                                    F.col("o_orderstatus").alias("head"), "o_orderkey"), ["repo"], "o_orderkey")


_PLAN = """stored AS (
  SELECT 'org/c' || o_custkey AS repo, arg_max(o_orderstatus, o_orderkey) AS commit_sha FROM orders
  WHERE o_orderdate < '1998-01-01' GROUP BY ALL),
heads AS (
  SELECT 'org/c' || o_custkey AS repo, arg_max(o_orderstatus, o_orderkey) AS head FROM orders
  WHERE o_orderdate >= '1997-01-01' GROUP BY ALL)"""


def repo_plan(spark, sf):
    return U.repo_plan(_heads(spark, sf).drop("o_orderkey"), _stored(spark, sf))


def delete_stale(spark, sf):
    return U.stale_repos(_stored(spark, sf), _heads(spark, sf)).select("repo", "commit_sha")


def _numbered(generation):
    """A stand-in model: the generation that embedded a text, and its length."""
    def make():
        return lambda texts: np.array([[generation, len(t)] for t in texts], dtype=np.float32)
    return make


def refresh_snapshot(spark, sf):
    """The whole refresh of an index from one snapshot of many repositories to the next.

    Documents are files, sources are repositories. Between the snapshots those labelled toxic were
    added, those of quality 0 deleted, and those of quality 1 have a line more. The first source in
    order is no longer listed, the last is still at its old head, so its files stay as they were."""
    docs = V.files(spark, sf).join(V.table(spark, sf, "labels"), "doc_id", "left")
    old = docs.where("coalesce(toxic, 0) = 0").select("repo", "path", "text")
    text = F.when(F.col("quality") == 1, F.concat("text", F.lit("\none more line"))).otherwise(F.col("text"))
    new = docs.where("coalesce(quality, 1) = 1").select("repo", "path", text.alias("text"))

    def snapshot(files):
        return files.select("repo", "path", F.encode("text", "utf-8").alias("content"), F.sha2("text", 256).alias("sha"))

    ends = docs.agg(F.min("repo").alias("first"), F.max("repo").alias("last"))
    names = docs.select("repo").distinct()
    heads = names.join(ends, F.col("repo") > F.col("first")).select(
        "repo", F.when(F.col("repo") == F.col("last"), "h1").otherwise("h2").alias("head"))
    store = IndexStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    store.refresh(snapshot(old), names.withColumn("head", F.lit("h1")), _numbered(1), now="t1")
    store.refresh(snapshot(new), heads, _numbered(2), now="t2")
    return store.chunks().join(store.repos(), "repo").select(
        "repo", "commit_sha", "path", "start_line", "end_line", F.md5("text").alias("digest"),
        F.element_at("embedding", 1).cast("int").alias("embedded_by"))


def refresh_after_merge(spark, sf):
    """Two parts of an index, made apart, are merged; the merged one is refreshed. What neither part
    lists as a file is taken anew, with the vectors that it has."""
    docs = V.files(spark, sf).join(V.table(spark, sf, "labels"), "doc_id", "left")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/merge-{uuid.uuid4().hex}"

    def snapshot(text):
        return docs.select("repo", "path", "prose", F.encode(text, "utf-8").alias("content"), F.sha2(text, 256).alias("sha"))

    names = docs.select("repo").distinct()
    parts = []
    for i, cond in enumerate(("prose = 'en'", "prose <> 'en'")):
        part = IndexStore(spark, f"{base}/{i}")
        part.refresh(snapshot(F.col("text")).where(cond).drop("prose"), names.withColumn("head", F.lit("h1")), _numbered(1), now=f"t{i}")
        parts.append({"chunks": part.chunks(), "repos": part.repos(), "meta": part.meta()})
    merged, store = U.merge_parts(parts), IndexStore(spark, f"{base}/merged")
    store.set_meta("model", store.model)
    store.put_chunks(merged["chunks"])
    store.set_repo_commits(merged["repos"])
    text = F.when(F.col("quality") == 1, F.concat("text", F.lit("\none more line"))).otherwise(F.col("text"))
    store.refresh(snapshot(text).drop("prose"), names.withColumn("head", F.lit("h2")), _numbered(2), now="t2")
    return store.chunks().join(store.repos(), "repo").select(
        "repo", "commit_sha", "path", "start_line", "end_line", F.md5("text").alias("digest"),
        F.element_at("embedding", 1).cast("int").alias("embedded_by"))


# chunks of both snapshots; a text that an old chunk of the same file has keeps its vector
_REFRESH = f"""docs AS (
  SELECT source AS repo, 'doc/' || d.doc_id || '.md' AS path, text, quality, toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
both_files AS (
  SELECT 1 AS gen, repo, path, text FROM docs WHERE coalesce(toxic, 0) = 0
  UNION ALL
  SELECT 2, repo, path, CASE WHEN quality = 1 THEN text || chr(10) || 'one more line' ELSE text END
  FROM docs WHERE coalesce(quality, 1) = 1),
{V.CHUNKS.replace(V.FILES, "files AS (SELECT gen || ' ' || repo AS repo, path, 0 AS doc_id, '' AS prose, text FROM both_files)")},
old_c AS (SELECT substring(repo, 3) AS repo, path, start_line, end_line, text FROM chunks WHERE repo LIKE '1 %'),
new_c AS (SELECT substring(repo, 3) AS repo, path, start_line, end_line, text FROM chunks WHERE repo LIKE '2 %'),
ends AS (SELECT min(repo) AS first, max(repo) AS last FROM docs)"""


# the same without the files that come or go
_MERGED = _REFRESH.replace("FROM docs WHERE coalesce(toxic, 0) = 0", "FROM docs").replace("FROM docs WHERE coalesce(quality, 1) = 1", "FROM docs")


def stride_shard(spark, sf):
    c = V.chunks(spark, sf).withColumn("id", F.col("doc_id"))
    return U.stride_shard(c, 3, 8).select("repo", "path", "start_line")


def merge_conflict_check(spark, sf):
    parts = V.table(spark, sf, "orders").select(F.format_string("org/c%d", "o_custkey").alias("repo"),
                                                F.col("o_orderstatus").alias("commit_sha"))
    return U.sha_conflicts(parts)


def merge_parts(spark, sf):
    """The chunks split by prose language and put together again, two repo lists into one."""
    c = V.chunks(spark, sf)
    repos = c.select("repo").distinct().select("repo", F.md5("repo").alias("commit_sha"))
    meta = spark.createDataFrame([("model", K.MODEL_NAME)], "key string, value string")
    parts = [{"chunks": c.where(cond), "repos": repos.withColumn("indexed_at", F.lit(at)), "meta": meta}
             for cond, at in (("prose = 'en'", "2024-01-01"), ("prose <> 'en'", "2024-01-02"))]
    merged = U.merge_parts(parts)
    return merged["chunks"].groupBy("repo").agg(F.count("*").alias("chunks")).join(merged["repos"], "repo")


def vector_cache_split(spark, sf):
    c = V.chunks(spark, sf)
    vec = F.array(F.length("text").cast("float"), F.col("start_line").cast("float"))
    cache = U.vector_cache(c.where("prose = 'en'").withColumn("embedding", vec)
                           .withColumn("id", F.struct("doc_id", "start_line")))
    stored = U.store_cache(cache, f"{ensure_checkpoint_dir(spark).rstrip('/')}/cache-{uuid.uuid4().hex}")
    return U.split_by_cache(c, stored, stored=True).select("repo", "path", "start_line",
                                                           F.element_at("embedding", 1).cast("int").alias("cached_len"))


def chunk_cache_build(spark, sf):
    c = V.chunks(spark, sf).withColumn("lang", F.lit("markdown"))
    repos = V.table(spark, sf, "nation").select(
        F.format_string("src%d", "n_nationkey").alias("repo"), F.col("n_name").alias("commit_sha"))
    return U.chunk_cache(repos, c).select("repo", "commit_sha", "path", "start_line", "end_line", "lang",
                                          F.md5("text").alias("digest"))


def chunk_cache_reuse(spark, sf):
    pins = V.table(spark, sf, "nation").where("n_regionkey < 3").select(
        F.format_string("src%d", "n_nationkey").alias("repo"), F.col("n_name").alias("commit_sha"))
    return U.reusable(chunk_cache_build(spark, sf), pins)


_CACHE = f"""{V.CHUNKS}, cache AS (
  SELECT coalesce(c.repo, r.repo) AS repo, coalesce(sha, '') AS commit_sha, path, start_line, end_line,
         CASE WHEN path IS NOT NULL THEN 'markdown' END AS lang, md5(text) AS digest
  FROM chunks c FULL JOIN (SELECT 'src' || n_nationkey AS repo, n_name AS sha FROM nation) r ON r.repo = c.repo)"""


def snapshot_locations(spark, sf):
    s = V.symbols(spark, sf)
    return s.select("id", T.file_key(F.col("repo"), F.col("path")).alias("file"),
                    T.location(F.col("repo"), F.col("path"), F.col("start_line")).alias("location"))


QUERIES = {
    "upsert_latest": (upsert_latest, f"""WITH {_SNAPSHOTS}
SELECT user_id, event_type, event_id, value FROM late_s"""),
    "changeset_diff": (changeset_diff, f"WITH {_SNAPSHOTS} SELECT * FROM changed"),
    "apply_changes": (apply_changes, f"WITH {_SNAPSHOTS} SELECT repo, path, sha FROM new_files"),
    "repo_plan": (repo_plan, f"""WITH {_PLAN}
SELECT h.repo, head, commit_sha, CASE WHEN commit_sha IS NULL THEN 'full' WHEN commit_sha = head THEN 'skip'
  ELSE 'diff' END AS action FROM heads h LEFT JOIN stored s ON s.repo = h.repo"""),
    "delete_stale": (delete_stale, f"""WITH {_PLAN}
SELECT * FROM stored WHERE repo NOT IN (SELECT repo FROM heads)"""),
    "stride_shard": (stride_shard, f"""WITH {V.CHUNKS}
SELECT repo, path, start_line FROM chunks
QUALIFY (row_number() OVER (PARTITION BY repo ORDER BY path, start_line, end_line, doc_id) - 1) % 8 = 3"""),
    "merge_conflict_check": (merge_conflict_check, """SELECT 'org/c' || o_custkey AS repo,
  min(o_orderstatus) AS first_sha, max(o_orderstatus) AS last_sha FROM orders
GROUP BY ALL HAVING min(o_orderstatus) <> max(o_orderstatus)"""),
    "merge_parts": (merge_parts, f"""WITH {V.CHUNKS}
SELECT repo, count(*) AS chunks, md5(repo) AS commit_sha, '2024-01-02' AS indexed_at FROM chunks GROUP BY repo"""),
    "vector_cache_split": (vector_cache_split, f"""WITH {V.CHUNKS}
SELECT repo, path, start_line, CAST(CASE WHEN prose = 'en' THEN length(text) END AS INTEGER) AS cached_len
FROM chunks"""),
    "chunk_cache_build": (chunk_cache_build, f"WITH {_CACHE} SELECT * FROM cache"),
    "chunk_cache_reuse": (chunk_cache_reuse, f"""WITH {_CACHE}
SELECT * FROM cache WHERE path IS NOT NULL AND (repo, commit_sha) IN (
  SELECT ('src' || n_nationkey, n_name) FROM nation WHERE n_regionkey < 3)"""),
    "refresh_snapshot": (refresh_snapshot, f"""WITH {_REFRESH}
SELECT repo, 'h2' AS commit_sha, path, start_line, end_line, md5(text) AS digest,
       CASE WHEN EXISTS (SELECT 1 FROM old_c o WHERE o.repo = n.repo AND o.path = n.path AND o.text = n.text)
            THEN 1 ELSE 2 END AS embedded_by
FROM new_c n, ends WHERE repo NOT IN (first, last)
UNION ALL
SELECT repo, 'h1', path, start_line, end_line, md5(text), 1 FROM old_c, ends WHERE repo = last"""),
    "refresh_after_merge": (refresh_after_merge, f"""WITH {_MERGED}
SELECT repo, 'h2' AS commit_sha, path, start_line, end_line, md5(text) AS digest,
       CASE WHEN EXISTS (SELECT 1 FROM old_c o WHERE o.repo = n.repo AND o.path = n.path AND o.text = n.text)
            THEN 1 ELSE 2 END AS embedded_by
FROM new_c n"""),
    "locations": (snapshot_locations, f"""WITH {V.SYMBOLS}
SELECT id, repo || '/' || path AS file, repo || '/' || path || ':' || start_line AS location FROM symbols"""),
}
