"""Queries over paths, texts and chunks."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import chunking, history
from ..sources import files as sources
from . import views as V

_EXTS = [".rs", ".PY", ".min.js", ".lock", ".md", ".d.ts", ".test.ts", ".txt", ".go", ".tsx",
         "", ".spec.js", ".yaml"]
_DIRS = ["src", "node_modules/x", "src/tests", "a/docs", "pkg/vendor", "lib", "a/dist/b"]


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _sql_pick(values, key):
    return f"[{', '.join(repr(v) for v in values)}][{key} % {len(values)} + 1]"


def _paths(spark, sf):
    d = F.col("doc_id")
    return V.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("repo"),
        F.concat(_pick(_DIRS, d), F.lit("/f"), d.cast("string"), _pick(_EXTS, d)).alias("path"))


_PATHS = f"""paths AS (
  SELECT doc_id, source AS repo,
         {_sql_pick(_DIRS, 'doc_id')} || '/f' || doc_id || {_sql_pick(_EXTS, 'doc_id')} AS path
  FROM documents)"""
_DIR_LIST = ", ".join(f"'{d}'" for d in K.EXCLUDED_DIRS)
_WANTED = f"""(NOT list_has_any(string_split(path, '/')[1:-2], [{_DIR_LIST}])
   AND NOT contains(split_part(path, '/', -1), '.min.') AND NOT ends_with(path, '.lock')
   AND split_part(path, '/', -1) <> 'package-lock.json')"""
_LANG = ("coalesce(MAP {" + ", ".join(f"'{e}': '{n}'" for e, n in K.LANG_BY_EXT.items())
         + r"}[lower(regexp_extract(split_part(path, '/', -1), '^\.*[^.].*?(\.[^.]*)$', 1))], '')")
_EXCLUDED = f"regexp_matches(repo || '/' || path, '{K.EXCLUDED_PATH_PATTERN}')"


def lang_map_filter(spark, sf):
    p = _paths(spark, sf).withColumn("lang", T.path_lang(F.col("path")))
    return p.where("lang <> ''").select("doc_id", "path", "lang")


def wanted_files(spark, sf):
    return _paths(spark, sf).where(T.wanted(F.col("path"))).select("doc_id", "repo", "path")


def exclude_filter(spark, sf):
    return _paths(spark, sf).select("doc_id", T.excluded_path(
        T.file_key(F.col("repo"), F.col("path"))).alias("excluded"))


_ROOTS = """roots AS (
  SELECT DISTINCT 'site ' || host AS repo, host AS root FROM urls
  UNION SELECT DISTINCT 'part ' || host || ' ' || lang, host || '/' || lang FROM urls WHERE lang IN ('en', 'de'))"""


def paths_to_repos(spark, sf):
    """Pages as files of their host's repository; two of its languages are repositories inside it."""
    url = V.table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    parts = url.select(F.split("path", "/").alias("p")).select(F.col("p")[0].alias("host"), F.get("p", F.lit(1)).alias("lang"))
    roots = parts.select(F.concat(F.lit("site "), "host").alias("repo"), F.col("host").alias("root")).distinct().unionByName(
        parts.where(F.col("lang").isin("en", "de")).select(
            F.concat(F.lit("part "), "host", F.lit(" "), "lang").alias("repo"), F.concat_ws("/", "host", "lang").alias("root")).distinct())
    return sources.paths_to_repos(url, roots).select("page_id", "repo", "root", "path")


def chunk_cover(spark, sf):
    """For each file its lines with text, and how many of them stand in full in some chunk."""
    files = V.files(spark, sf).withColumn("path", F.col("path"))
    parts = chunking.chunk_files(files.select("repo", "path", "text"), "repo")
    held = parts.select("path", "start_line", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")) \
        .select("path", (F.col("start_line") + F.col("i")).alias("n"), "line").distinct()
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")) \
        .where(F.col("line").rlike(r"(?U)\S")).select("path", (F.col("i") + 1).alias("n"), "line")
    return lines.join(held.withColumn("held", F.lit(1)), ["path", "n", "line"], "left").groupBy("path").agg(
        F.count("*").alias("lines"), F.count("held").alias("covered"))


def _change_rows(spark, sf):
    status = _pick(["A", "M", "D"], F.floor(F.col("doc_id") / 3))
    return _paths(spark, sf).withColumn("status", status)


def indexable_changes(spark, sf):
    return _change_rows(spark, sf).where(T.indexable_change(F.col("status"), F.col("path"))) \
        .select("doc_id", "status", "path")


_PREFIXES = ["Merge ", "", "Bump ", "feat: ", "chore(deps): ", "  fix ", "REVERT "]


def clean_query(spark, sf):
    c = V.table(spark, sf, "conversations")
    subject = F.concat(_pick(_PREFIXES, F.col("conv_id") + F.col("turn")), "text",
                       F.lit(" (#"), F.col("turn").cast("string"), F.lit(")"))
    return c.select("conv_id", "turn", T.clean_query(subject).alias("query")).where("query IS NOT NULL")


def line_windows(spark, sf):
    return V.chunks(spark, sf).select("repo", "path", "start_line", "end_line",
                                      F.length("text").alias("text_len"), F.md5("text").alias("digest"))


def embed_text_hash(spark, sf):
    text = T.embed_text(F.col("repo"), F.col("path"), F.col("text"))
    return V.chunks(spark, sf).select("repo", "path", "start_line",
                                      F.lower(F.hex(T.text_hash(text))).alias("hash"))


def snippet_head(spark, sf):
    return V.files(spark, sf).select("doc_id", F.md5(T.snippet(F.col("text"))).alias("digest"),
                                     F.length(T.snippet(F.col("text"))).alias("chars"))


def tokens_overlap(spark, sf):
    p = V.table(spark, sf, "pages", busy=True).select("page_id", T.tokens(F.col("html")).alias("q"),
                                           T.tokens(F.col("url")).alias("c"))
    return p.select("page_id", F.size("q").alias("query_tokens"), F.size("c").alias("url_tokens"),
                    F.round(T.overlap(F.col("q"), F.col("c")), 6).alias("overlap"))


def _sql_tokens(text):
    spaced = rf"regexp_replace({text}, '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    bare = f"lower(regexp_replace({spaced}, '{K.TOKEN_SPLIT_PATTERN}', ' ', 'g'))"
    stop = ", ".join(f"'{w}'" for w in K.STOPWORDS)
    return (f"list_distinct(list_filter(string_split({bare}, ' '), "
            f"lambda t: len(t) > 1 AND NOT list_contains([{stop}], t)))")


def text_decode(spark, sf):
    raw = V.table(spark, sf, "documents").select("doc_id", F.encode(
        F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit("\0"))
                 .otherwise("")), "utf-8").alias("content"))
    return raw.withColumn("text", sources.decode_text(F.col("content"))) \
        .select("doc_id", F.length("text").alias("chars"))


# Modules that one task parses, some seconds' work.
_MODULES = 5000


def _python_files(spark, sf):
    """One small Python module per part; the class is as long as the part's size."""
    k = F.col("p_partkey").cast("string")
    return V.table(spark, sf, "part", busy=True, rows=_MODULES).select(
        "p_partkey", "p_size", F.format_string("pkg/m%d.py", "p_partkey").alias("path"),
        F.concat(F.lit("import os\n\n@cached\ndef f_"), k, F.lit("(a):\n    return a\n\nclass C"), k,
                 F.lit(":\n"), F.repeat(F.lit("    x = 1\n"), F.col("p_size") * 8),
                 F.lit("    def m(self):\n        return 2\n")).alias("text"))


def chunk_python_files(spark, sf):
    return chunking.chunk_files(_python_files(spark, sf), "p_partkey", "p_size") \
        .select("p_partkey", "lang", "start_line", "end_line", "symbol",
                F.length("text").alias("text_len"))


# The class (and with it its body lines) is one chunk until it has more than 250 lines or
# 8000 bytes; then only its method is, and the rest falls into windows. The import is one of its own.
_CHUNK_PYTHON = r"""WITH p AS (
  SELECT p_partkey, p_size * 8 AS b,
         p_size * 8 + 3 <= 250 AND 42 + length(p_partkey::VARCHAR) + p_size * 80 <= 8000 AS whole
  FROM part),
gap AS (
  SELECT p_partkey, b, unnest(generate_series(0,
           CAST(ceil(greatest(2 + b - 80, 0) / 65.0) AS BIGINT))) AS i
  FROM p WHERE NOT whole),
win AS (
  SELECT p_partkey, CAST(6 + i * 65 AS INTEGER) AS s, CAST(least(6 + i * 65 + 79, 7 + b) AS INTEGER) AS e
  FROM gap)
SELECT p_partkey, 'python' AS lang, 3 AS start_line, 5 AS end_line, 'f_' || p_partkey AS symbol,
       CAST(31 + length(p_partkey::VARCHAR) AS INTEGER) AS text_len FROM p
UNION ALL
SELECT p_partkey, 'python', 1, 2, '', 10 FROM p
UNION ALL
SELECT p_partkey, 'python', 7, CAST(9 + b AS INTEGER), 'C' || p_partkey,
       CAST(42 + length(p_partkey::VARCHAR) + b * 10 AS INTEGER) FROM p WHERE whole
UNION ALL
SELECT p_partkey, 'python', CAST(8 + b AS INTEGER), CAST(9 + b AS INTEGER), 'm', 33 FROM p WHERE NOT whole
UNION ALL
SELECT p_partkey, 'python', s, e, '',
       CAST(CASE WHEN s = 6 THEN 9 + length(p_partkey::VARCHAR) + (e - 7) * 10
                 ELSE (e - s + 1) * 10 - 1 END AS INTEGER) FROM win"""


def diff_lines(spark, sf):
    e = V.events(spark, sf)
    n = F.floor(F.col("value")).cast("int")
    line = (F.when(F.col("event_type") == "view", F.concat(F.lit("+++ b/src/"), (n % 5).cast("string"), F.lit(".rs")))
            .when(F.col("event_type") == "error", F.lit("+++ /dev/null"))
            .when(F.col("event_type") == "click", F.concat(
                F.lit("@@ -1,2 +"), n.cast("string"), F.lit(","), (n % 4).cast("string"), F.lit(" @@ fn")))
            .otherwise(F.concat(F.lit("@@ -7 +"), n.cast("string"), F.lit(" @@"))))
    return e.select(F.col("user_id").alias("change"), F.col("event_id").alias("line_no"), line.alias("line"))


DIFF = """diff AS (
  SELECT user_id AS change, event_id AS line_no, event_type AS kind, CAST(floor(value) AS INTEGER) AS n,
         CASE event_type WHEN 'view' THEN 'src/' || (CAST(floor(value) AS INTEGER) % 5) || '.rs'
                         WHEN 'error' THEN '' END AS header
  FROM events),
hunks AS (
  SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY change ORDER BY line_no) AS path,
         CASE WHEN kind = 'click' THEN n % 4 ELSE 1 END AS cnt
  FROM diff),
ranges AS (
  SELECT change, path, n AS first, CAST(n + cnt - 1 AS INTEGER) AS last FROM hunks
  WHERE header IS NULL AND path <> '' AND cnt > 0)"""


def added_ranges(spark, sf):
    return history.added_ranges(diff_lines(spark, sf))


def changed_chunks(spark, sf):
    pieces = V.table(spark, sf, "part").select(
        (F.col("p_partkey") % 50).alias("change"), F.format_string("src/%d.rs", F.col("p_partkey") % 5).alias("path"),
        F.col("p_size").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 7).cast("int").alias("end_line"),
        F.col("p_partkey").alias("chunk"))
    return history.changed_chunks(pieces, added_ranges(spark, sf)).select("change", "path", "chunk")


def _commits(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select(
        F.format_string("org/c%d", F.col("o_custkey") % 9).alias("repo"), F.col("o_orderkey").cast("string").alias("sha"),
        F.unix_timestamp("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "P").alias("merge"),
        F.concat(_pick(_PREFIXES, F.col("o_orderkey")), F.lit("order "), "o_orderpriority", F.lit(" (#3)")).alias("subject"))


def _commit_files(spark, sf):
    li = V.table(spark, sf, "lineitem", busy=True).join(
        V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return li.select(
        F.format_string("org/c%d", F.col("o_custkey") % 9).alias("repo"), F.col("l_orderkey").cast("string").alias("sha"),
        F.when(F.col("l_returnflag") == "R", "D").when(F.col("l_returnflag") == "A", "A").otherwise("M").alias("status"),
        F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"),
                 _pick(_EXTS, F.col("l_suppkey"))).alias("path")).distinct()


def collect_queries(spark, sf):
    q = history.collect_queries(_commits(spark, sf), _commit_files(spark, sf), since=883612800)
    return q.select("repo", "sha", "ts", "query", F.array_join("files", ",").alias("files"))


_COLLECT = f"""WITH commits AS (
  SELECT 'org/c' || (o_custkey % 9) AS repo, o_orderkey::VARCHAR AS sha,
         CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderstatus = 'P' AS merge,
         trim(regexp_replace({_sql_pick(_PREFIXES, 'o_orderkey')} || 'order ' || o_orderpriority || ' (#3)',
              '{K.PR_SUFFIX_PATTERN}', '')) AS query
  FROM orders),
changes AS (
  SELECT DISTINCT 'org/c' || (o_custkey % 9) AS repo, l_orderkey::VARCHAR AS sha,
         CASE l_returnflag WHEN 'R' THEN 'D' WHEN 'A' THEN 'A' ELSE 'M' END AS status,
         'src/p' || l_partkey || '_' || l_linenumber || {_sql_pick(_EXTS, 'l_suppkey')} AS path
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
kept AS (
  SELECT repo, sha, list_sort(list(path)) AS files FROM changes
  WHERE status <> 'D' AND {_WANTED} AND {_LANG} <> ''
    AND NOT regexp_matches(path, '{K.EXCLUDED_PATH_PATTERN}')
  GROUP BY ALL)
SELECT c.repo, c.sha, ts, query, array_to_string(files, ',') AS files
FROM commits c JOIN kept k ON k.repo = c.repo AND k.sha = c.sha
WHERE NOT merge AND ts >= 883612800 AND length(query) >= 1
  AND NOT regexp_matches(query, '{K.NOISE_SUBJECT_PATTERN}')"""


def repo_listing(spark, sf):
    c = V.table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.floor(F.greatest("c_acctbal", F.lit(0.0))).cast("long").alias("size"),
        (F.col("c_mktsegment") == "BUILDING").alias("fork"), (F.col("c_nationkey") < 5).alias("archived"))
    return sources.indexable_repos(c)


def local_clones(spark, sf):
    clones = V.table(spark, sf, "supplier").select(
        F.format_string("dir%04d", "s_suppkey").alias("name"),
        F.concat(F.lit("git@github.com:Org/repo"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".git")).alias("url"))
    indexed = V.table(spark, sf, "nation").select(F.format_string("org/Repo%d", "n_nationkey").alias("repo"))
    return sources.local_clones(clones, indexed)


QUERIES = {
    "lang_map_filter": (lang_map_filter, f"""WITH {_PATHS}
SELECT * FROM (SELECT doc_id, path, {_LANG} AS lang FROM paths) WHERE lang <> ''"""),
    "wanted_files": (wanted_files, f"WITH {_PATHS} SELECT doc_id, repo, path FROM paths WHERE {_WANTED}"),
    "exclude_filter": (exclude_filter, f"WITH {_PATHS} SELECT doc_id, {_EXCLUDED} AS excluded FROM paths"),
    "indexable_changes": (indexable_changes, f"""WITH {_PATHS}
SELECT * FROM (SELECT doc_id, {_sql_pick(['A', 'M', 'D'], '(doc_id // 3)')} AS status, path FROM paths)
WHERE status <> 'D' AND {_WANTED} AND {_LANG} <> ''
  AND NOT regexp_matches(path, '{K.EXCLUDED_PATH_PATTERN}')"""),
    "clean_query": (clean_query, rf"""WITH s AS (
  SELECT conv_id, turn, regexp_replace(regexp_replace(
           {_sql_pick(_PREFIXES, '(conv_id + turn)')} || text || ' (#' || turn || ')',
           '{K.PR_SUFFIX_PATTERN}', ''), '^\s+|\s+$', '', 'g') AS query
  FROM conversations)
SELECT conv_id, turn, query FROM s
WHERE length(query) >= 1 AND NOT regexp_matches(query, '{K.NOISE_SUBJECT_PATTERN}')"""),
    "line_windows": (line_windows, f"""WITH {V.CHUNKS}
SELECT repo, path, start_line, end_line, CAST(length(text) AS INTEGER) AS text_len, md5(text) AS digest FROM chunks"""),
    "embed_text_hash": (embed_text_hash, f"""WITH {V.CHUNKS}
SELECT repo, path, start_line, sha256('{K.MODEL_NAME}' || chr(0) || repo || '/' || path || chr(10)
       || text) AS hash FROM chunks"""),
    "snippet_head": (snippet_head, f"""WITH {V.FILES}, s AS (
  SELECT doc_id, array_to_string(string_split(text, chr(10))[1:25], chr(10)) AS t FROM files)
SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM s"""),
    "tokens_overlap": (tokens_overlap, f"""WITH t AS (
  SELECT page_id, {_sql_tokens('html')} AS q, {_sql_tokens('url')} AS c FROM pages)
SELECT page_id, CAST(len(q) AS INTEGER) AS query_tokens, CAST(len(c) AS INTEGER) AS url_tokens,
       round(CASE WHEN len(q) = 0 OR len(c) = 0 THEN 0.0
                  ELSE len(list_intersect(q, c)) / len(c) END, 6) AS overlap FROM t"""),
    "text_decode": (text_decode, """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN CAST(length(text) AS INTEGER) END AS chars
FROM documents"""),
    "paths_to_repos": (paths_to_repos, f"""WITH urls AS (
  SELECT page_id, path, split_part(path, '/', 1) AS host, split_part(path, '/', 2) AS lang
  FROM (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)), {_ROOTS}
SELECT page_id, arg_max(repo, length(root)) AS repo, max_by(root, length(root)) AS root,
       substring(any_value(path), max(length(root)) + 2) AS path
FROM urls JOIN roots ON starts_with(path, root || '/') GROUP BY page_id"""),
    "chunk_cover": (chunk_cover, rf"""WITH {V.FILES}, l AS (
  SELECT path, unnest(string_split(text, chr(10))) AS line FROM files)
SELECT path, count(*) AS lines, count(*) AS covered FROM l
WHERE regexp_matches(line, '[^\s\v\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]') GROUP BY path"""),
    "chunk_python_files": (chunk_python_files, _CHUNK_PYTHON),
    "added_ranges": (added_ranges, f"WITH {DIFF} SELECT change, path, first, last FROM ranges"),
    "changed_chunks": (changed_chunks, f"""WITH {DIFF}, pieces AS (
  SELECT p_partkey % 50 AS change, 'src/' || (p_partkey % 5) || '.rs' AS path, p_size AS start_line,
         p_size + p_partkey % 7 AS end_line, p_partkey AS chunk FROM part)
SELECT change, path, chunk FROM pieces p WHERE EXISTS (
  SELECT 1 FROM ranges r WHERE r.change = p.change AND r.path = p.path
     AND p.start_line <= r.last AND p.end_line >= r.first)"""),
    "collect_queries": (collect_queries, _COLLECT),
    "repo_listing": (repo_listing, """SELECT c_name AS name FROM customer
WHERE floor(greatest(c_acctbal, 0)) <> 0 AND c_mktsegment <> 'BUILDING' AND c_nationkey >= 5"""),
    "local_clones": (local_clones, """WITH c AS (
  SELECT printf('dir%04d', s_suppkey) AS name, 'org/repo' || (s_suppkey % 40) AS slug FROM supplier)
SELECT 'org/Repo' || n_nationkey AS repo, max(name) AS name
FROM nation JOIN c ON slug = 'org/repo' || n_nationkey GROUP BY ALL"""),
}
