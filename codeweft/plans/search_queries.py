"""Nearest-neighbour search and cross-repository duplicates."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.vectors import cos_from_distance
from ..operators import duplicates as D, history, knn
from ..session import cut, ensure_checkpoint_dir
from ..sources import files
from . import text_queries, views as V

_R = 6


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, _R))
    return df


def _with_cos(df):
    return _rounded(df.withColumn("cos", cos_from_distance(F.col("distance"))), "distance", "cos")


_NEAR = V.VCHUNKS + """, near AS (
  SELECT c.*, list_distance(c.embedding, q.embedding) AS distance
  FROM vchunks c, (SELECT embedding FROM vchunks WHERE id = 7) q)"""
_COS = "round(1 - distance * distance / 2, 6) AS cos"


def knn_topk(spark, sf):
    found = knn.top_k(V.vchunks(spark, sf), V.query_vector(spark, sf), 20, carry=("repo", "path", "symbol"))
    return _with_cos(found)


def knn_wide_hits(spark, sf):
    """Top k first, wide columns joined to those k rows."""
    c = V.vchunks(spark, sf)
    near = knn.top_k(c, V.query_vector(spark, sf), 50)
    return _rounded(knn.hits(c, near, "repo", "path", "lang", "text_len"), "distance", "cos")


def knn_repo_postfilter(spark, sf):
    return _with_cos(knn.post_filtered(V.vchunks(spark, sf), V.query_vector(spark, sf), "org/repo3", 8, ("path",)))


def knn_bounded(spark, sf):
    """knn_topk by way of a stored table of quantised vectors."""
    c = V.vchunks(spark, sf)
    found = knn.bounded_top_k(c, cut(knn.quantised(c)), V.query_vector(spark, sf), 20, carry=("repo", "path", "symbol"))
    return _with_cos(found)


def knn_repo_prefilter(spark, sf):
    return _with_cos(knn.pre_filtered(V.vchunks(spark, sf), V.query_vector(spark, sf), "org/repo3", 8, ("path",)))


def _queries(spark, sf):
    return V.vchunks(spark, sf).select(F.col("id").alias("qid"), F.col("repo").alias("own_repo"), "embedding")


def knn_batch_topk(spark, sf):
    return _rounded(knn.batch_top_k(_queries(spark, sf), V.vchunks(spark, sf), 10), "distance") \
        .withColumn("rank", F.col("rank").cast("long"))


def nearest_foreign(spark, sf):
    found = knn.nearest_foreign(_queries(spark, sf), V.vchunks(spark, sf), 0.35)
    return _rounded(found, "cos").select("qid", "own_repo", "repo", "path", "symbol", "cos")


def similar_end_to_end(spark, sf):
    """From the lines that a change adds to the nearest foreign chunk of each chunk it touches."""
    c = V.vchunks(spark, sf)
    pieces = c.select((F.col("id") % 50).alias("change"), F.format_string("src/%d.rs", F.col("id") % 5).alias("path"),
                      "start_line", "end_line", F.col("id").alias("chunk"))
    touched = history.changed_chunks(pieces, history.added_ranges(text_queries.diff_lines(spark, sf))).select(F.col("chunk").alias("qid")).distinct()
    found = knn.nearest_foreign(_queries(spark, sf).join(touched, "qid", "left_semi"), c, 0.35)
    return _rounded(found, "cos").select("qid", F.concat_ws("/", "repo", "path").alias("other"), "symbol", "cos")


# Vectors are random here, so the best foreign cosine stays near 0.5: the cut is lowered from
# its default to where pairs exist.
CUT = 0.30


def _analysed(spark, sf):
    return D.analysis_set(V.vchunks(spark, sf))


def best_foreign_match(spark, sf):
    return _rounded(D.best_foreign(_analysed(spark, sf)), "sim")


def dup_pairs(spark, sf):
    return D.find_pairs(_analysed(spark, sf), CUT)


def ledger_delta(spark, sf):
    """The ledger after a change, from the best matches before it. Fourth chunks of files are new, first
    ones of one repository are gone, second ones of another have a new vector (that of the next chunk)."""
    now = V.vchunks(spark, sf)
    after = now.select("id", F.col("embedding").alias("next")).withColumn("id", F.col("id") - 1)
    moved = (F.col("repo") == "org/repo2") & (F.col("start_line") == 41)
    old = D.analysis_set(now.where("start_line < 121"))
    gone = (F.col("repo") == "org/repo3") & (F.col("start_line") == 1)
    new = D.analysis_set(now.join(after, "id", "left").withColumn(
        "embedding", F.when(moved, F.coalesce("next", "embedding")).otherwise(F.col("embedding"))).where(~gone))
    added = new.where((F.col("start_line") == 121) | moved)
    best = cut(D.best_foreign(old, CUT))
    return D.pairs_of(D.refreshed_best(best, old, old.where(gone | moved), added, CUT), new)


def dup_new_vs_baseline(spark, sf):
    return D.new_pairs(dup_pairs(spark, sf), D.find_pairs(_analysed(spark, sf), CUT + 0.05))


def ledger_symmetric(spark, sf):
    return D.both_directions(dup_pairs(spark, sf))


def ledger_round_trip(spark, sf):
    """The ledger as it is stored, read back and seen from either file."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    D.in_report_order(dup_pairs(spark, sf)).write.json(path)
    return D.both_directions(files.read_ledger(spark, path))


def dup_ledger_lookup(spark, sf):
    c = V.vchunks(spark, sf)
    found = knn.top_k(c, V.query_vector(spark, sf), 200, carry=("repo", "path"))
    return knn.annotate_duplicates(found, ledger_symmetric(spark, sf)) \
        .where("other IS NOT NULL").select("id", "file", "other", "n", "max_sim")


_ANALYSED = V.VCHUNKS + """, analysed AS (
  SELECT id, repo, repo || '/' || path AS file, symbol, embedding,
         sqrt(list_inner_product(embedding, embedding)) + 1e-9 AS norm
  FROM vchunks
  WHERE lang = 'rust' AND symbol <> ''
    AND NOT regexp_matches(repo || '/' || path, '/tests?/')),
sims AS (
  SELECT a.id, b.id AS best_id, round(list_inner_product(a.embedding, b.embedding) / a.norm / b.norm, 9) AS sim,
         a.file AS fa, b.file AS fb, a.symbol
  FROM analysed a JOIN analysed b ON a.repo <> b.repo),
best AS (
  SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, best_id) = 1)"""


def _pairs_sql(name, cut):
    return f"""{name} AS (
  SELECT least(fa, fb) AS a, greatest(fa, fb) AS b, count(*) AS n, round(max(sim), 3) AS max_sim,
         arg_max(symbol, (sim, -id)) AS example
  FROM best WHERE sim >= {cut} GROUP BY ALL)"""


_DELTA = _ANALYSED.replace("analysed AS (", """changed AS (
  SELECT c.* REPLACE (CASE WHEN c.repo = 'org/repo2' AND c.start_line = 41 THEN coalesce(n.embedding, c.embedding)
                      ELSE c.embedding END AS embedding)
  FROM vchunks c LEFT JOIN vchunks n ON n.id = c.id + 1 WHERE NOT (c.repo = 'org/repo3' AND c.start_line = 1)),
analysed AS (""").replace("  FROM vchunks\n  WHERE lang", "  FROM changed\n  WHERE lang")
_PAIRS = f"{_ANALYSED}, {_pairs_sql('pairs', CUT)}"
_LEDGER = _PAIRS + """, ledger AS (
  SELECT a AS file, b AS other, n, max_sim FROM pairs UNION ALL
  SELECT b, a, n, max_sim FROM pairs)"""

QUERIES = {
    "knn_topk": (knn_topk, f"""WITH {_NEAR}
SELECT id, repo, path, symbol, round(distance, 6) AS distance, {_COS}
FROM near ORDER BY near.distance, id LIMIT 20"""),
    "knn_wide_hits": (knn_wide_hits, f"""WITH {_NEAR}
SELECT id, repo, path, lang, text_len, round(distance, 6) AS distance, {_COS}
FROM near ORDER BY near.distance, id LIMIT 50"""),
    "knn_bounded": (knn_bounded, f"""WITH {_NEAR}
SELECT id, repo, path, symbol, round(distance, 6) AS distance, {_COS}
FROM near ORDER BY near.distance, id LIMIT 20"""),
    "knn_repo_postfilter": (knn_repo_postfilter, f"""WITH {_NEAR}
SELECT id, repo, path, round(distance, 6) AS distance, {_COS}
FROM near WHERE repo = 'org/repo3' ORDER BY near.distance, id LIMIT 8"""),
    "knn_repo_prefilter": (knn_repo_prefilter, f"""WITH {_NEAR}
SELECT id, repo, path, round(distance, 6) AS distance, {_COS}
FROM near WHERE repo = 'org/repo3' ORDER BY near.distance, id LIMIT 8"""),
    "knn_batch_topk": (knn_batch_topk, f"""WITH {V.CANDIDATES}
SELECT qid, id, round(distance, 6) AS distance, rank FROM candidates WHERE rank < 10"""),
    "nearest_foreign": (nearest_foreign, f"""WITH {V.VCHUNKS}, other AS (
  SELECT q.id AS qid, q.repo AS own_repo, c.repo, c.path, c.symbol, list_distance(q.embedding, c.embedding) AS d, c.id
  FROM vchunks q JOIN vchunks c ON c.repo <> q.repo)
SELECT qid, own_repo, repo, path, symbol, round(1 - d * d / 2, 6) AS cos FROM other
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) = 1 AND 1 - d * d / 2 >= 0.35"""),
    "best_foreign_match": (best_foreign_match, f"""WITH {_ANALYSED}
SELECT id, best_id, round(sim, 6) AS sim FROM best"""),
    "dup_pairs": (dup_pairs, f"WITH {_PAIRS} SELECT * FROM pairs"),
    "ledger_delta": (ledger_delta, f"""WITH {_DELTA}, {_pairs_sql('pairs', CUT)} SELECT * FROM pairs"""),
    "dup_new_vs_baseline": (dup_new_vs_baseline, f"""WITH {_PAIRS}, {_pairs_sql('known', CUT + 0.05)}
SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.a = p.a AND k.b = p.b)"""),
    "ledger_round_trip": (ledger_round_trip, f"WITH {_LEDGER} SELECT * FROM ledger"),
    "similar_end_to_end": (similar_end_to_end, f"""WITH {text_queries.DIFF}, {V.VCHUNKS}, touched AS (
  SELECT DISTINCT v.* FROM vchunks v JOIN ranges r ON r.change = v.id % 50 AND r.path = 'src/' || (v.id % 5) || '.rs'
    AND r.first <= v.end_line AND r.last >= v.start_line),
other AS (
  SELECT q.id AS qid, c.repo, c.path, c.symbol, list_distance(q.embedding, c.embedding) AS d, c.id
  FROM touched q JOIN vchunks c ON c.repo <> q.repo)
SELECT qid, repo || '/' || path AS other, symbol, round(1 - d * d / 2, 6) AS cos FROM other
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) = 1 AND 1 - d * d / 2 >= 0.35"""),
    "ledger_symmetric": (ledger_symmetric, f"WITH {_LEDGER} SELECT * FROM ledger"),
    "dup_ledger_lookup": (dup_ledger_lookup, f"""WITH {_LEDGER}, near AS (
  SELECT c.id, c.repo || '/' || c.path AS file
  FROM vchunks c, (SELECT embedding FROM vchunks WHERE id = 7) q
  ORDER BY list_distance(c.embedding, q.embedding), c.id LIMIT 200)
SELECT id, near.file, other, n, max_sim FROM near JOIN ledger ON ledger.file = near.file"""),
}
