"""Stand-in views: the driver tables in the shapes the operators expect.

Each view exists twice, as a DataFrame and as a SQL fragment for the oracle; the two are
kept side by side.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.chunking import line_windows
from ..session import spread


_scans: dict = {}


def table(spark: SparkSession, sf: str, name: str, busy: bool = False, rows: int | None = None) -> DataFrame:
    """A driver table; `busy` ones feed per-row text work and are spread over all cores, in tasks of about
    `rows` at most if that is given."""
    path = f"{sf}/{name}.parquet"
    key = spark.sparkContext.applicationId, path
    if key not in _scans:                 # handles only: saves asking for the schema again
        _scans[key] = spark.read.parquet(path)
    return spread(_scans[key], rows) if busy else _scans[key]


# -- files and their chunks, from documents
def files(spark, sf):
    return table(spark, sf, "documents", busy=True).select(
        F.col("source").alias("repo"), F.format_string("doc/%d.md", "doc_id").alias("path"),
        "doc_id", F.col("lang").alias("prose"), "text")


FILES = """files AS (
  SELECT source AS repo, 'doc/' || doc_id || '.md' AS path, doc_id, lang AS prose, text
  FROM documents)"""


def chunks(spark, sf):
    return line_windows(files(spark, sf), "repo", "path", "doc_id", "prose")


# Python-style blank test: any character that is neither white space nor a separator
CHUNKS = FILES + r""", file_lines AS (
  SELECT *, string_split(text, chr(10)) AS ls FROM files),
cuts AS (
  SELECT repo, path, doc_id, prose, ls, len(ls) AS n,
         unnest(generate_series(0, CAST(ceil(greatest(len(ls) - 80, 0) / 65.0) AS BIGINT))) AS i
  FROM file_lines),
segs AS (
  SELECT repo, path, doc_id, prose, CAST(i * 65 + 1 AS INTEGER) AS start_line,
         CAST(least(i * 65 + 80, n) AS INTEGER) AS end_line,
         list_slice(ls, i * 65 + 1, least(i * 65 + 80, n)) AS seg
  FROM cuts),
chunks AS (
  SELECT repo, path, doc_id, prose, start_line, end_line, '' AS symbol,
         array_to_string(seg, chr(10)) AS text
  FROM segs
  WHERE len(list_filter(seg, lambda s: regexp_matches(s, '[^\s\v\p{Z}\x{1c}-\x{1f}\x{85}]'))) >= 1)"""


# -- chunks with vectors, from embeddings
def vchunks(spark, sf):
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("id"), F.format_string("org/repo%d", "label").alias("repo"),
        F.concat(F.lit("src/"), F.when(F.floor(v / 4) % 10 == 3, "tests/").otherwise(""),
                 F.format_string("f%d.rs", F.floor(v / 4))).alias("path"),
        ((v % 4) * 40 + 1).cast("int").alias("start_line"),
        ((v % 4) * 40 + 40).cast("int").alias("end_line"),
        F.when(v % 9 == 0, "").otherwise(F.format_string("s%d", "vec_id")).alias("symbol"),
        F.when(v % 5 == 0, "markdown").otherwise("rust").alias("lang"),
        (v * 7 + 120).cast("int").alias("text_len"), "label", "embedding")


VCHUNKS = """vchunks AS (
  SELECT vec_id AS id, 'org/repo' || label AS repo, 
         'src/' || CASE WHEN (vec_id // 4) % 10 = 3 THEN 'tests/' ELSE '' END
           || 'f' || (vec_id // 4) || '.rs' AS path,
         CAST((vec_id % 4) * 40 + 1 AS INTEGER) AS start_line,
         CAST((vec_id % 4) * 40 + 40 AS INTEGER) AS end_line,
         CASE WHEN vec_id % 9 = 0 THEN '' ELSE 's' || vec_id END AS symbol,
         CASE WHEN vec_id % 5 = 0 THEN 'markdown' ELSE 'rust' END AS lang,
         CAST(vec_id * 7 + 120 AS INTEGER) AS text_len, label,
         embedding::DOUBLE[] AS embedding
  FROM embeddings)"""


def query_vector(spark, sf):
    """One embedded query: the vector of chunk 7."""
    return table(spark, sf, "embeddings").where("vec_id = 7").first()["embedding"]


# -- call graph, from part and lineitem
def symbols(spark, sf):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        p.alias("id"), F.col("p_brand").alias("repo"), F.col("p_type").alias("name"),
        F.when(F.col("p_size") > 25, "method").otherwise("function").alias("kind"),
        F.format_string("src/%d.rs", p % 20).alias("path"), F.col("p_size").alias("start_line"),
        (F.col("p_size") + p % 40).cast("int").alias("end_line"))


SYMBOLS = """symbols AS (
  SELECT p_partkey AS id, p_brand AS repo, p_type AS name,
         CASE WHEN p_size > 25 THEN 'method' ELSE 'function' END AS kind,
         'src/' || (p_partkey % 20) || '.rs' AS path, p_size AS start_line,
         CAST(p_size + p_partkey % 40 AS INTEGER) AS end_line
  FROM part)"""


def refs(spark, sf):
    n = table(spark, sf, "part").count()
    s = F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("symbol_id"), F.format_string("org/%d", s % 7).alias("repo"),
        F.format_string("src/%d.rs", "l_suppkey").alias("path"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linenumber") != 7, (F.col("l_partkey") * 7 + s) % n).alias("enclosing_symbol_id"),
        F.when(F.col("l_returnflag") == "R", "implementation").otherwise("reference").alias("role"))


REFS = """refs AS (
  SELECT l_partkey AS symbol_id, 'org/' || (l_suppkey % 7) AS repo,
         'src/' || l_suppkey || '.rs' AS path, l_linenumber AS line,
         CASE WHEN l_linenumber <> 7
              THEN (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) END AS enclosing_symbol_id,
         CASE WHEN l_returnflag = 'R' THEN 'implementation' ELSE 'reference' END AS role
  FROM lineitem)"""


# -- a flat symbol index, from part (definitions) and lineitem (uses)
_SCHEME = "tool cargo demo 0.1.0 "


def _symbol_text():
    p = F.col("p_partkey")
    member = F.translate("p_name", " ", "_")
    return F.concat(F.lit(_SCHEME), F.when(
        p % 3 == 0, F.concat(F.lit("m/impl#[T"), p.cast("string"), F.lit("]["), F.col("p_type"),
                             F.lit("]"), member, F.lit("().")))
        .when(p % 3 == 1, F.concat(F.lit("m/"), F.col("p_type"), F.lit("#"), member, F.lit("(+"),
                                   p.cast("string"), F.lit(").")))
        .otherwise(F.concat(F.lit("m/`"), F.col("p_name"), F.lit("``"), p.cast("string"),
                            F.lit(".ts`/C#value."))))


_SYMBOL_SQL = f"""'{_SCHEME}' || CASE p_partkey % 3
    WHEN 0 THEN 'm/impl#[T' || p_partkey || '][' || p_type || ']' || replace(p_name, ' ', '_') || '().'
    WHEN 1 THEN 'm/' || p_type || '#' || replace(p_name, ' ', '_') || '(+' || p_partkey || ').'
    ELSE 'm/`' || p_name || '``' || p_partkey || '.ts`/C#value.' END"""


def scip_flat(spark, sf):
    """Occurrences in part/lineitem form; siblings of one brand and size share a body."""
    from ..operators.scip import Flat
    p = F.col("p_partkey")
    part = table(spark, sf, "part").withColumn("symbol", _symbol_text())
    doc = (p % 20).cast("int")
    defs = part.select(
        F.col("p_brand").alias("repo"), F.format_string("src/%d.rs", p % 20).alias("path"),
        doc.alias("doc"), p.cast("int").alias("pos"), "symbol", F.lit(True).alias("is_def"),
        (p % 4 != 0).alias("has_body"),
        F.when(p % 4 != 0, F.col("p_size")).otherwise(F.col("p_size") + p % 29).cast("int").alias("s_line"),
        F.lit(0).alias("s_ch"),
        F.when(p % 4 != 0, F.col("p_size") + 30).otherwise(F.col("p_size") + p % 29).cast("int").alias("e_line"),
        F.lit(1).alias("e_ch"),
        (F.col("p_size") + p % 29).cast("int").alias("n_line"), (p % 5).cast("int").alias("n_ch"))
    used = part.select(F.col("p_partkey").alias("l_partkey"), "symbol", F.col("p_brand").alias("repo"))
    uses = table(spark, sf, "lineitem").join(used, "l_partkey").select(
        "repo", F.concat(F.lit("src/"), (F.col("l_suppkey") % 20).cast("string"), F.lit(".rs")).alias("path"),
        (F.col("l_suppkey") % 20).cast("int").alias("doc"), F.lit(1 << 30).alias("pos"), "symbol",
        F.lit(False).alias("is_def"), F.lit(False).alias("has_body"),
        F.col("l_quantity").cast("int").alias("s_line"), F.lit(0).alias("s_ch"),
        F.col("l_quantity").cast("int").alias("e_line"), F.lit(0).alias("e_ch"),
        F.col("l_quantity").cast("int").alias("n_line"), F.col("l_linenumber").alias("n_ch"))
    infos = part.select(F.col("p_brand").alias("repo"), doc.alias("doc"), p.cast("int").alias("pos"),
                        "symbol", (p % 90).cast("int").alias("kind"),
                        F.when(p % 2 == 0, F.col("p_name")).alias("display_name"))
    rels = part.where("p_size = 1").select(
        F.col("p_brand").alias("repo"), F.format_string("src/%d.rs", p % 20).alias("path"),
        doc.alias("doc"), "symbol", F.concat(F.lit("ext npm lib 1 x/"), F.col("p_type"), F.lit("#"))
        .alias("target"), F.lit("type_definition").alias("role"))
    docs = defs.select("repo", "doc").distinct().groupBy("repo").agg(F.count("*").alias("n"))
    return Flat(defs.unionByName(uses), infos, rels, docs)


SCIP = f"""defs AS (
  SELECT p_brand AS repo, 'src/' || (p_partkey % 20) || '.rs' AS path, p_partkey % 20 AS doc,
         p_partkey AS pos, {_SYMBOL_SQL} AS symbol, p_partkey % 4 <> 0 AS has_body,
         CASE WHEN p_partkey % 4 <> 0 THEN p_size ELSE p_size + p_partkey % 29 END AS s_line,
         CASE WHEN p_partkey % 4 <> 0 THEN p_size + 30 ELSE p_size + p_partkey % 29 END AS e_line,
         p_size + p_partkey % 29 AS n_line,
         p_partkey % 5 AS n_ch, p_partkey, p_name, p_type, p_size
  FROM part),
uses AS (
  SELECT d.repo, 'src/' || (l_suppkey % 20) || '.rs' AS path, l_suppkey % 20 AS doc, d.symbol,
         CAST(l_quantity AS INTEGER) AS line, l_linenumber AS ch
  FROM lineitem JOIN defs d ON d.p_partkey = l_partkey),
members AS (
  SELECT *, count(*) OVER g AS n, min(pos) OVER g AS first,
         lead(n_line) OVER (PARTITION BY repo, doc, s_line ORDER BY n_line, n_ch, pos) AS nxt,
         row_number() OVER (PARTITION BY repo, doc, s_line ORDER BY n_line, n_ch, pos) AS member
  FROM defs WHERE has_body WINDOW g AS (PARTITION BY repo, doc, s_line)),
slices AS (
  SELECT repo, doc, symbol, first, CASE WHEN n = 1 THEN 0 ELSE member END AS member,
         CASE WHEN n = 1 THEN s_line ELSE n_line END AS s_line,
         CASE WHEN n = 1 THEN 0 ELSE n_ch END AS s_ch,
         CASE WHEN n = 1 OR nxt IS NULL THEN e_line ELSE greatest(nxt - 1, n_line) END AS e_line,
         CASE WHEN n = 1 OR nxt IS NULL THEN 1 ELSE 1073741824 END AS e_ch
  FROM members)"""


# -- ranked candidate lists: every vector is a query
def candidates(spark, sf, k: int = 30):
    from ..operators.knn import batch_top_k
    from ..functions.text import tokens
    chunk = vchunks(spark, sf)
    near = batch_top_k(chunk.select(F.col("id").alias("qid"), "embedding"), chunk, k)
    # tokenising the queries is the heavy part of their side, so it is spread
    asked = spread(table(spark, sf, "embeddings").select("vec_id", "label")).select(
        F.col("vec_id").alias("qid"), F.format_string("org/repo%d", "label").alias("query_repo"),
                         F.col("label").alias("query_label")) \
        .join(table(spark, sf, "documents", busy=True).select(F.col("doc_id").alias("qid"),
                                                   "text"), "qid", "left") \
        .withColumn("query_tokens", tokens(F.concat(
            F.coalesce("text", F.lit("")), F.lit(" src/f"), F.floor(F.col("qid") / 4).cast("string"),
            F.lit(" S"), F.col("qid").cast("string")))).drop("text")
    meta = chunk.drop("embedding")
    return near.drop("rank").join(meta, "id").join(asked, "qid")


def scored(spark, sf):
    """Candidate lists with cosine score and same-label positives."""
    from ..functions.vectors import cos_from_distance
    from pyspark.sql import Window as W
    w = W.partitionBy("qid").orderBy("distance", "id")
    return (candidates(spark, sf)
            .withColumn("rank", F.row_number().over(w) - 1)
            .withColumn("score", F.round(cos_from_distance(F.col("distance")), 9))
            .withColumn("label", (F.col("label") == F.col("query_label")).cast("int")))


CANDIDATES = VCHUNKS + """, ranked AS (
  SELECT q.id AS qid, c.id, q.repo AS query_repo, q.label AS query_label,
         list_distance(q.embedding, c.embedding) AS distance,
         row_number() OVER (PARTITION BY q.id
           ORDER BY round(list_distance(q.embedding, c.embedding), 9), c.id) AS rn
  FROM vchunks q CROSS JOIN vchunks c),
candidates AS (
  SELECT r.qid, r.id, r.query_repo, r.query_label, r.distance, r.rn - 1 AS rank,
         round(1 - r.distance * r.distance / 2, 9) AS score,
         CASE WHEN c.label = r.query_label THEN 1 ELSE 0 END AS label,
         c.repo, c.path, c.start_line, c.end_line, c.symbol, c.lang, c.text_len
  FROM ranked r JOIN vchunks c ON c.id = r.id WHERE r.rn <= 30)"""


# -- snapshots over time, from events
def events(spark, sf):
    return table(spark, sf, "events")


MIDYEAR_SQL = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


def midpoint(spark, sf):
    row = events(spark, sf).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return row["a"] + (row["b"] - row["a"]) / 2
