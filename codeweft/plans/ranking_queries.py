"""Features, forest scores and metrics over candidate lists."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import FEATURES
from ..operators import boosting, features as G, history, metrics as M
from ..operators.forest import Forest, package
from ..session import cut, ensure_checkpoint_dir
from ..sources import files
from . import views as V
from .text_queries import _sql_tokens


def group_features(spark, sf):
    rows = G.group_features(V.candidates(spark, sf))
    return rows.select("qid", "id", *[F.round(f, 6).alias(f) for f in FEATURES])


_FEATURES = V.CANDIDATES + f""", qtok AS (
  SELECT v.id AS qid, {_sql_tokens("coalesce(d.text, '') || ' src/f' || (v.id // 4) || ' S' || v.id")} AS q
  FROM vchunks v LEFT JOIN documents d ON d.doc_id = v.id),
ctok AS (SELECT id, {_sql_tokens('path')} AS p, {_sql_tokens('symbol')} AS s FROM vchunks),
st AS (
  SELECT *, 1 - distance * distance / 2 AS cos, avg(1 - distance * distance / 2) OVER g AS mean,
         stddev_pop(1 - distance * distance / 2) OVER g AS std, count(*) OVER g AS size,
         count(*) OVER (PARTITION BY qid, repo, path) AS same
  FROM candidates WINDOW g AS (PARTITION BY qid)),
feats AS (
  SELECT st.qid, st.id, cos, distance, CAST(rank AS DOUBLE) AS rank, max(cos) OVER (PARTITION BY st.qid) - cos AS cos_gap_top,
         CASE WHEN std > 1e-9 THEN (cos - mean) / std ELSE 0.0 END AS cos_z,
         max(cos) OVER (PARTITION BY st.qid) AS cos_top1,
         CASE WHEN repo = query_repo THEN 1.0::DOUBLE ELSE 0.0 END AS same_repo,
         CAST(len(string_split(path, '/')) AS DOUBLE) AS path_depth,
         CASE WHEN len(q) = 0 OR len(p) = 0 THEN 0.0 ELSE len(list_intersect(q, p)) / len(p) END AS path_overlap,
         CASE WHEN len(q) = 0 OR len(s) = 0 THEN 0.0 ELSE len(list_intersect(q, s)) / len(s) END AS symbol_overlap,
         CASE WHEN symbol <> '' THEN 1.0::DOUBLE ELSE 0.0 END AS has_symbol, ln(1 + text_len) AS log_text_len,
         CASE WHEN lang = 'rust' THEN 1.0::DOUBLE ELSE 0.0 END AS is_code_lang,
         CASE WHEN regexp_matches(repo || '/' || path, '/tests?/') THEN 1.0::DOUBLE ELSE 0.0 END AS is_excluded_path,
         same / size AS same_file_frac
  FROM st JOIN qtok USING (qid) JOIN ctok ON ctok.id = st.id)"""


def label_positives(spark, sf):
    v = V.vchunks(spark, sf)
    touched = V.table(spark, sf, "lineitem").join(
        v.select(F.col("id").alias("l_suppkey"), F.concat("repo", F.lit("/"), "path").alias("file")), "l_suppkey") \
        .select(F.col("l_partkey").alias("qid"), "file")
    return G.label(V.candidates(spark, sf).drop("label"), touched).select("qid", "id", "label")


# A small fixed forest, enough to send rows down every kind of branch.
_TREES = [
    {"f": [0, 6, -1, -1, -1], "t": [0.25, 0.5, 0.0, 0.0, 0.0], "l": [1, 2, -1, -1, -1],
     "r": [4, 3, -1, -1, -1], "v": [0.0, 0.0, -0.7, 0.2, 0.9]},
    {"f": [4, -1, 14, -1, -1], "t": [0.1, 0.0, 0.04, 0.0, 0.0], "l": [1, -1, 3, -1, -1],
     "r": [2, -1, 4, -1, -1], "v": [0.0, -0.3, 0.0, 0.4, 0.1]},
    {"f": [11, -1, -1], "t": [7.0, 0.0, 0.0], "l": [1, -1, -1], "r": [2, -1, -1], "v": [0.0, 0.05, -0.2]},
]
_MODEL = package(_TREES, FEATURES, 0.5)


def _tree_sql(t, i=0):
    if t["f"][i] < 0:
        return str(t["v"][i]) + "::DOUBLE"
    return (f"CASE WHEN {FEATURES[t['f'][i]]} <= {t['t'][i]} THEN {_tree_sql(t, t['l'][i])} "
            f"ELSE {_tree_sql(t, t['r'][i])} END")


def forest_score(spark, sf):
    rows = G.group_features(V.candidates(spark, sf))
    return Forest.of(_MODEL).apply(rows).select("qid", "id", F.round("raw", 6).alias("raw"),
                                                F.round("score", 6).alias("score"), "inject")


def prf_at_threshold(spark, sf):
    return M.prf(V.scored(spark, sf), F.col("score") >= 0.25)


def best_threshold(spark, sf):
    return M.best_threshold(V.scored(spark, sf))


def baseline_repo_and_cos(spark, sf):
    rows = V.scored(spark, sf).withColumn("cos", F.col("score")) \
        .withColumn("same_repo", (F.col("id") % 3 == F.col("qid") % 3).cast("int"))
    return M.best_threshold(M.baseline_scores(rows), "repo_and_cos")


def average_precision(spark, sf):
    return M.average_precision(V.scored(spark, sf))


def label_average_precision(spark, sf):
    d = V.table(spark, sf, "labels").join(V.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.average_precision(d.select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label")))


def precision_at_k(spark, sf):
    return M.precision_at_k(V.scored(spark, sf))


def ndcg_at_k(spark, sf):
    return M.ndcg_at_k(V.scored(spark, sf))


def ndcg_tied_scores(spark, sf):
    return M.ndcg_at_k(V.scored(spark, sf).withColumn("score", F.floor(F.col("score") * 20)))


def time_split(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("sha"),
                                            F.unix_timestamp("o_orderdate").alias("ts"))
    return M.time_split(o).select("sha", "part")


def split_conditions(spark, sf):
    rows = V.table(spark, sf, "lineitem").join(
        V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"),
        "l_orderkey").select(F.col("l_orderkey").alias("qid"), (F.col("o_custkey") % 11).alias("query_repo"),
                             F.unix_timestamp("o_orderdate").alias("ts"),
                             (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return M.conditions(rows)


def _parts(spark, sf):
    """Queries split by age into train and test; a query's id stands for its time."""
    groups = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("ts"),
                                                     F.format_string("%012d", "vec_id").alias("sha"))
    return M.time_split(groups).select("qid", (F.col("part") == "test").alias("is_test"))


def evaluate_split(spark, sf):
    """A cut tuned on the older queries, everything else measured on the newer ones."""
    rows = cut(V.scored(spark, sf).join(_parts(spark, sf), "qid"))
    found = M.evaluate(rows.where("NOT is_test"), rows.where("is_test"))
    return spark.createDataFrame([tuple(found.values())], list(found))


def dataset_groups(spark, sf):
    """Query groups written as JSON, read back and taken apart into candidates."""
    repo = F.format_string("org/repo%d", "label")
    queries = V.table(spark, sf, "embeddings").select(
        repo.alias("repo"), F.col("vec_id").cast("string").alias("sha"), (F.col("vec_id") * 100).alias("ts"),
        F.format_string("change of s%d", "vec_id").alias("query"))
    rows = V.scored(spark, sf).withColumn("qid", F.concat(F.col("query_repo"), F.lit("@"), F.col("qid").cast("string")))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/groups-{uuid.uuid4().hex}"
    history.build_groups(queries, rows).write.json(path)
    back = files.read_groups(spark, path)
    return history.explode_groups(back, False, "n_pos").select(
        "qid", "ts", "n_pos", F.col("id").alias("place"), "repo", "path", "start_line", "symbol", "text_len", "label",
        F.round("distance", 6).alias("distance"), F.size("query_tokens").alias("tokens"))


def boosted_margins(spark, sf):
    """Margins of a leaf-wise boosted model, learned from the older queries' candidates and applied to all."""
    labelled = V.candidates(spark, sf).withColumn("label", (F.col("label") == F.col("query_label")).cast("int"))
    rows = cut(G.group_features(labelled).join(_parts(spark, sf), "qid"))
    model = boosting.train(rows, FEATURES, boosting.Options(rounds=8, rate=0.2, refresh=4), validation="is_test")
    return Forest.of(model).apply(rows).select("qid", "id", "label", F.round("raw", 6).alias("raw"))


def _ap_sql(rows):
    return f"""{rows}, g AS (
  SELECT score, sum(label) AS h, count(*) AS n FROM rows GROUP BY score),
c AS (
  SELECT h, sum(h) OVER w AS ctp, sum(n) OVER w AS cn, sum(h) OVER () AS p FROM g
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(h / p * ctp / cn), 4) AS pr_auc FROM c"""


def _best_sql(rows):
    return f"""{rows}, cuts AS (SELECT DISTINCT round(score, 4) AS cut FROM rows),
packed AS (SELECT score, sum(label) AS h, count(*) AS n FROM rows GROUP BY score),
m AS (
  SELECT cut, sum(h) AS tp, sum(n) AS sel, (SELECT sum(h) FROM packed) AS pos
  FROM cuts LEFT JOIN packed ON score >= cut GROUP BY cut),
f AS (
  SELECT cut, coalesce(tp, 0) / sel AS p, coalesce(tp, 0) / pos AS r FROM m)
SELECT cut AS threshold, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1
FROM f ORDER BY f1 DESC, cut LIMIT 1"""


def _ndcg_sql(score, rows="candidates", head=f"WITH {V.CANDIDATES}, "):
    def disc(n, k):
        return (f"coalesce((SELECT sum(1 / log2(i + 2)) FROM range({k}) t(i) WHERE i < {n}), 0)")
    cols = ", ".join(f"round(avg(d{k} / {disc('pos', k)}), 4) AS ndcg_at_{k}" for k in (5, 10))
    gains = ", ".join(f"sum(CASE WHEN rn <= {k} THEN g / log2(rn + 1) ELSE 0 END) AS d{k}" for k in (5, 10))
    return f"""{head}r AS (
  SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC) AS rn,
         avg(label) OVER (PARTITION BY qid, {score}) AS g FROM {rows}),
per AS (SELECT qid, least(sum(label), 10) AS pos, {gains} FROM r GROUP BY qid)
SELECT {cols} FROM per"""


_EVALUATE = f"""WITH {V.CANDIDATES}, parts AS (
  SELECT vec_id AS qid, row_number() OVER (ORDER BY vec_id) > floor((SELECT count(*) FROM embeddings) * 0.8) AS is_test FROM embeddings),
train AS (SELECT c.* FROM candidates c JOIN parts USING (qid) WHERE NOT is_test),
test AS (SELECT c.* FROM candidates c JOIN parts USING (qid) WHERE is_test),
best AS ({_best_sql("WITH rows AS (SELECT * FROM train)")}),
found AS (
  SELECT count_if(label = 1 AND score >= threshold) AS tp, count_if(label = 0 AND score >= threshold) AS fp,
         count_if(label = 1 AND score < threshold) AS fn FROM test, best),
ap AS ({_ap_sql("WITH rows AS (SELECT * FROM test)")}),
ndcg AS ({_ndcg_sql("score", "test", "WITH ")}),
at_k AS (
  WITH r AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS rn,
                    count(*) OVER (PARTITION BY qid) AS n FROM test),
  per AS (SELECT qid, sum(CASE WHEN rn <= 5 THEN label ELSE 0 END) / least(5, max(n)) AS a,
                 sum(CASE WHEN rn <= 10 THEN label ELSE 0 END) / least(10, max(n)) AS b FROM r GROUP BY qid)
  SELECT round(avg(a), 4) AS p_at_5, round(avg(b), 4) AS p_at_10 FROM per)
SELECT threshold, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
       round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1,
       tp + fp AS selected, pr_auc, ndcg_at_5, ndcg_at_10, p_at_5, p_at_10
FROM best, found, ap, ndcg, at_k"""
_ROWS = f"WITH {V.CANDIDATES}, rows AS (SELECT * FROM candidates)"

QUERIES = {
    "group_features": (group_features, f"""WITH {_FEATURES}
SELECT qid, id, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)} FROM feats"""),
    "label_positives": (label_positives, f"""WITH {V.CANDIDATES}, touched AS (
  SELECT DISTINCT l_partkey AS qid, repo || '/' || path AS file FROM lineitem JOIN vchunks v ON v.id = l_suppkey)
SELECT c.qid, c.id, CASE WHEN t.file IS NULL THEN 0 ELSE 1 END AS label FROM candidates c
LEFT JOIN touched t ON t.qid = c.qid AND t.file = c.repo || '/' || c.path"""),
    "forest_score": (forest_score, f"""WITH {_FEATURES}, s AS (
  SELECT qid, id, {' + '.join(f'({_tree_sql(t)})' for t in _TREES)} AS raw FROM feats)
SELECT qid, id, round(raw, 6) AS raw, round(1 / (1 + exp(-raw)), 6) AS score, raw >= 0 AS inject FROM s"""),
    "prf_at_threshold": (prf_at_threshold, f"""WITH {V.CANDIDATES}, c AS (
  SELECT count_if(label = 1 AND score >= 0.25) AS tp, count_if(label = 0 AND score >= 0.25) AS fp,
         count_if(label = 1 AND score < 0.25) AS fn FROM candidates)
SELECT round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
       round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1,
       tp + fp AS selected FROM c"""),
    "best_threshold": (best_threshold, _best_sql(_ROWS)),
    "baseline_repo_and_cos": (baseline_repo_and_cos, _best_sql(f"""WITH {V.CANDIDATES}, rows AS (
  SELECT CASE WHEN id % 3 = qid % 3 THEN score ELSE -1.0 END AS score, label FROM candidates)""")),
    "average_precision": (average_precision, _ap_sql(_ROWS)),
    "label_average_precision": (label_average_precision, _ap_sql("""WITH rows AS (
  SELECT n_chars AS score, quality AS label FROM labels JOIN documents USING (doc_id))""")),
    "precision_at_k": (precision_at_k, f"""WITH {V.CANDIDATES}, r AS (
  SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS rn,
         count(*) OVER (PARTITION BY qid) AS n FROM candidates),
per AS (SELECT qid, sum(CASE WHEN rn <= 5 THEN label ELSE 0 END) / least(5, max(n)) AS a,
               sum(CASE WHEN rn <= 10 THEN label ELSE 0 END) / least(10, max(n)) AS b FROM r GROUP BY qid)
SELECT round(avg(a), 4) AS p_at_5, round(avg(b), 4) AS p_at_10 FROM per"""),
    "ndcg_at_k": (ndcg_at_k, _ndcg_sql("score")),
    "ndcg_tied_scores": (ndcg_tied_scores, _ndcg_sql("floor(score * 20)")),
    "evaluate_split": (evaluate_split, _EVALUATE),
    "boosted_margins": (boosted_margins, None),
    "dataset_groups": (dataset_groups, f"""WITH {V.CANDIDATES}
SELECT query_repo || '@' || qid AS qid, qid * 100 AS ts, CAST(sum(label) OVER (PARTITION BY qid) AS INTEGER) AS n_pos,
       CAST(rank AS INTEGER) AS place, repo, path, start_line, symbol, text_len, label, round(distance, 6) AS distance, 2 AS tokens
FROM candidates"""),
    "time_split": (time_split, """WITH n AS (SELECT count(*) AS n FROM orders), c AS (
  SELECT CAST(floor(n * 0.8) AS BIGINT) AS cut, CAST(floor(floor(n * 0.8) * 0.85) AS BIGINT) AS fit FROM n)
SELECT sha, CASE WHEN pos < fit THEN 'fit' WHEN pos < cut THEN 'valid' ELSE 'test' END AS part FROM (
  SELECT o_orderkey::VARCHAR AS sha, row_number() OVER (ORDER BY o_orderdate, o_orderkey::VARCHAR) - 1 AS pos
  FROM orders), c"""),
    "split_conditions": (split_conditions, """SELECT count(DISTINCT l_orderkey) AS queries,
  count(DISTINCT o_custkey % 11) AS repos, count(*) AS candidates, count_if(l_returnflag = 'R') AS positives,
  round(count_if(l_returnflag = 'R') / count(*), 4) AS positive_rate,
  strftime(min(o_orderdate), '%Y-%m-%d') AS first_commit, strftime(max(o_orderdate), '%Y-%m-%d') AS last_commit
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""),
}
