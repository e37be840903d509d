"""Call graph: ingest steps over flat occurrences and the caller lookups."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scip_symbols as S
from ..operators import callgraph as C, scip, stabbing
from ..session import ensure_checkpoint_dir
from ..sources import scip_json
from . import views as V


def targets_by_symbol(spark, sf):
    return C.targets_by_symbol(V.symbols(spark, sf), "ECONOMY")


def targets_whole_file(spark, sf):
    return C.targets_by_path(V.symbols(spark, sf), "src/3.rs")


def targets_by_path_innermost(spark, sf):
    return C.targets_by_path(V.symbols(spark, sf), "src/3.rs", lines="20-40")


def _by_path(spark, sf):
    return C.targets_by_path(V.symbols(spark, sf), "src/3.rs", lines="20-21")


def impl_hop(spark, sf):
    return C.implemented_by(V.refs(spark, sf), V.symbols(spark, sf), _by_path(spark, sf))


def _callers(spark, sf, targets, k):
    sym, ref = V.symbols(spark, sf), V.refs(spark, sf)
    found = C.callers(ref, sym, C.follow_implementations(ref, sym, targets), k)
    return found if k is None else found.limit(k)


def callers_topk(spark, sf):
    t = C.targets_by_symbol(V.symbols(spark, sf), "ECONOMY", "Brand#11")
    return _callers(spark, sf, t, 30)


def callers_of_path(spark, sf):
    return _callers(spark, sf, _by_path(spark, sf), None)


def callers_file_scope(spark, sf):
    t = C.targets_by_symbol(V.symbols(spark, sf), "SMALL", "Brand#4")
    sites = C.call_sites(V.refs(spark, sf), V.symbols(spark, sf), t)
    return C.distinct_callers(sites.where("enclosing_symbol_id IS NULL")).select(
        F.concat("repo", F.lit("/"), "path", F.lit(":"), F.col("line").cast("string")).alias("location"),
        F.coalesce(F.nullif("name", F.lit("")), F.lit("(file scope)")).alias("enclosing"))


def _by_symbol_sql(name, repo=""):
    where = f" AND repo = '{repo}'" if repo else ""
    return f"targets AS (SELECT * FROM symbols WHERE name = '{name}'{where})"


def _by_path_sql(low, high):
    # a definition stays if no end among those that start with it or later, and are shorter, is within it
    return f"""near_s AS (
  SELECT *, end_line - start_line AS span FROM symbols
  WHERE path = 'src/3.rs' AND start_line <= {high} AND end_line >= {low}),
holds AS (
  SELECT o.id, count(inner_s.id) AS n FROM near_s o
  LEFT JOIN near_s inner_s ON inner_s.repo = o.repo AND inner_s.span < o.span
    AND inner_s.start_line BETWEEN o.start_line AND o.end_line AND inner_s.end_line <= o.end_line
  GROUP BY o.id),
targets AS (SELECT near_s.* EXCLUDE (span) FROM near_s JOIN holds USING (id) WHERE n = 0)"""


_HOP = """hop AS (
  SELECT DISTINCT s.* FROM refs r JOIN symbols s ON s.id = r.symbol_id
  WHERE r.role = 'implementation' AND r.enclosing_symbol_id IN (SELECT id FROM targets)
    AND s.id NOT IN (SELECT id FROM targets))"""


def _callers_sql(targets, k):
    return f"""WITH {V.SYMBOLS}, {V.REFS}, {targets}, {_HOP},
asked AS (SELECT id, name FROM targets UNION ALL SELECT id, name FROM hop),
fetched AS (
  SELECT r.*, a.name AS target_name FROM refs r JOIN asked a ON a.id = r.symbol_id),
sites AS (
  SELECT f.repo, f.path, f.line, f.role, f.target_name, e.name, e.kind, e.path AS def_path,
         e.start_line AS def_start_line, e.end_line AS def_end_line
  FROM fetched f LEFT JOIN symbols e ON e.id = f.enclosing_symbol_id
  QUALIFY row_number() OVER (PARTITION BY f.repo, f.path, f.line, e.name
     ORDER BY f.symbol_id, f.enclosing_symbol_id NULLS FIRST, f.role) = 1)
SELECT * FROM sites{f" ORDER BY repo, path, line, name NULLS FIRST LIMIT {k}" if k else ""}"""


def find_callers_full(spark, sf):
    """The whole answer for one name: targets, the first callers, freshness, and whether there are more."""
    nation = V.table(spark, sf, "nation")
    org = F.concat(F.lit("org/"), F.col("n_nationkey").cast("string")).alias("repo")
    repos = nation.select(org, F.col("n_name").alias("commit_sha"), F.lit("t").alias("indexed_at"), F.lit("x").alias("tool"))
    graph = {"symbols": V.symbols(spark, sf), "refs": V.refs(spark, sf), "repos": repos}
    return C.find_callers(graph, symbol="ECONOMY", repo="Brand#11", k=30).rows()


_FULL = """, shown AS (
  SELECT * FROM sites ORDER BY repo, path, line, name NULLS FIRST LIMIT 30),
more AS (SELECT count(*) > 30 AS truncated FROM sites)
SELECT part, repo, path, line, name, note, truncated FROM (
  SELECT 'target' AS part, repo, path, start_line AS line, name, kind AS note FROM targets
  UNION ALL SELECT 'target', repo, path, start_line, name, kind || ' by implementation' FROM hop
  UNION ALL SELECT 'caller', repo, path, line, name, role FROM shown
  UNION ALL SELECT 'repo', 'org/' || n_nationkey, NULL, NULL, NULL, n_name FROM nation
  WHERE 'org/' || n_nationkey IN (SELECT repo FROM shown)), more"""


def nested_documents(spark, sf):
    """The flat stand-in index as nested documents, with local symbols, names of three and of four
    numbers, and relationships that carry both flags."""
    flat = V.scip_flat(spark, sf)
    o = flat.occurrences
    place = F.when((F.col("n_ch") % 2) == 0, F.array("n_line", "n_ch", F.col("n_ch") + 1)).otherwise(
        F.array("n_line", "n_ch", "n_line", F.col("n_ch") + 1))
    ints = lambda *c: F.array(*[F.col(x).cast("int") for x in c])
    item = F.struct(place.cast("array<int>").alias("range"), "symbol", F.col("is_def").cast("int").alias("symbol_roles"),
                    F.when(F.col("has_body"), ints("s_line", "s_ch", "e_line", "e_ch")).alias("enclosing_range"))
    # only definitions, which come first, have a position that counts
    placed = F.struct(F.col("pos").alias("at"), "symbol", item.alias("o"))
    local = F.array(F.struct(F.array(F.lit(1), F.lit(0), F.lit(2)).alias("range"), F.lit("local 7").alias("symbol"),
                             F.lit(0).alias("symbol_roles"), F.lit(None).cast("array<int>").alias("enclosing_range")))
    uses = o.groupBy("repo", "doc", F.col("path").alias("relative_path")).agg(F.concat(
        local, F.transform(F.sort_array(F.collect_list(F.when(F.col("is_def"), placed))), lambda x: x["o"]),
        F.collect_list(F.when(~F.col("is_def"), item))).alias("occurrences"))
    related = flat.relations.groupBy("repo", "doc", "symbol").agg(F.collect_list(F.struct(
        F.col("target").alias("symbol"), F.lit(True).alias("is_implementation"), F.lit(False).alias("is_reference"),
        F.lit(True).alias("is_type_definition"))).alias("relationships"))
    infos = flat.infos.join(related, ["repo", "doc", "symbol"], "left").groupBy("repo", "doc").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("at"), "symbol", "kind", "display_name", "relationships"))),
                    lambda x: F.struct(x["symbol"].alias("symbol"), x["kind"].alias("kind"), x["display_name"].alias("display_name"),
                                       x["relationships"].alias("relationships"))).alias("symbols"))
    return uses.join(infos, ["repo", "doc"], "left")


def scip_from_documents(spark, sf):
    """References of an index that is read as JSON, one document a line, from a splittable file."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    nested_documents(spark, sf).write.json(path)
    return scip.ingest(scip.flatten_documents(scip_json.read_documents(spark, path))).refs


def enclosing_stab(spark, sf):
    k = F.col("o_orderkey")
    points = V.table(spark, sf, "orders").select(
        "o_orderkey", F.format_string("src/%d.rs", k % 20).alias("path"),
        (F.col("o_custkey") % 100).cast("int").alias("line"), (k % 17).cast("int").alias("ch"))
    s = V.symbols(spark, sf)
    bodies = s.select("path", F.col("start_line").alias("s_line"), (F.col("id") % 11).cast("int").alias("s_ch"),
                      F.col("end_line").alias("e_line"), (F.col("id") % 13).cast("int").alias("e_ch"),
                      F.col("id").alias("ordinal"), F.col("id").alias("enclosing"))
    around = stabbing.resolve_enclosing(points, bodies, ["path"], "enclosing")
    return points.join(around, ["path", "line", "ch"]).select("o_orderkey", "enclosing")


def shared_body_slices(spark, sf):
    return scip.body_slices(V.scip_flat(spark, sf).occurrences).select(
        "repo", "doc", "symbol", "s_line", "s_ch", "e_line", "e_ch")


def descriptors_parse(spark, sf):
    d = V.scip_flat(spark, sf).infos.withColumn("d", S.descriptors(F.col("symbol")))
    return d.select("symbol", F.array_join(F.transform("d", lambda x: F.concat(
        x["name"], F.lit("="), x["kind"])), "|").alias("parts"))


def kind_lookup(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", F.coalesce(
        S.kind_name((F.col("p_partkey") % 90).cast("int")), F.lit("unknown")).alias("kind"))


def symbol_intern_last_wins(spark, sf):
    o = V.table(spark, sf, "orders")
    name = F.concat(F.lit("t cargo d 1 m/C"), F.col("o_custkey").cast("string"), F.lit("#run()."))
    defined = o.select((F.format_string("org/%d", F.col("o_custkey") % 5)).alias("repo"), name.alias("symbol"),
                       F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("display_name"),
                       F.lit(26).alias("code"), F.format_string("src/%d.rs", "o_orderkey").alias("path"),
                       (F.col("o_orderkey") % 90).cast("int").alias("start_line"),
                       (F.col("o_orderkey") % 90 + 5).cast("int").alias("end_line"))
    seen = V.table(spark, sf, "lineitem").select(
        F.format_string("org/%d", F.col("l_partkey") % 5).alias("repo"),
        F.concat(F.lit("t cargo d 1 m/C"), F.col("l_partkey").cast("string"), F.lit("#run().")).alias("symbol"))
    return scip.intern_symbols(defined, seen)


def _ingested(spark, sf):
    return scip.ingest(V.scip_flat(spark, sf))


def scip_symbols(spark, sf):
    return _ingested(spark, sf).symbols


def scip_refs(spark, sf):
    return _ingested(spark, sf).refs


def scip_stats(spark, sf):
    return _ingested(spark, sf).stats


def impl_edges_unique(spark, sf):
    return scip.derive_impl_edges(_ingested(spark, sf).symbols)


_KINDS = "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in K.SYMBOL_KINDS.items()) + "}"
_GRAPH = V.SCIP + f""", known AS (
  SELECT d.*, replace(p_name, ' ', '_') AS member,
         coalesce({_KINDS}[p_partkey % 90], CASE WHEN p_partkey % 3 = 2 THEN 'term' ELSE 'method' END) AS kind,
         CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 2 THEN 'value'
              ELSE replace(p_name, ' ', '_') END AS name,
         CAST(coalesce(s.s_line, d.s_line) + 1 AS INTEGER) AS start_line,
         CAST(coalesce(s.e_line, d.e_line) + 1 AS INTEGER) AS end_line
  FROM defs d LEFT JOIN slices s ON s.repo = d.repo AND s.doc = d.doc AND s.symbol = d.symbol),
unique_members AS (
  SELECT repo, p_type, member, min(symbol) AS target FROM known WHERE p_partkey % 3 = 1
  GROUP BY ALL HAVING count(*) = 1),
derived AS (
  SELECT k.repo, k.symbol, k.path, k.start_line AS line, k.p_type AS trait, k.member, u.target
  FROM known k LEFT JOIN unique_members u ON u.repo = k.repo AND u.p_type = k.p_type AND u.member = k.member
  WHERE k.p_partkey % 3 = 0),
spots AS (SELECT DISTINCT repo, doc, line, ch FROM uses),
around AS (
  SELECT p.*, s.symbol AS enclosing FROM spots p LEFT JOIN slices s
    ON s.repo = p.repo AND s.doc = p.doc AND (s.s_line, s.s_ch) <= (p.line, p.ch)
       AND (p.line, p.ch) <= (s.e_line, s.e_ch)
  QUALIFY row_number() OVER (PARTITION BY p.repo, p.doc, p.line, p.ch
    ORDER BY s.s_line DESC, s.s_ch DESC, s.e_line, s.e_ch, s.first DESC, s.member DESC) = 1),
calls AS (
  SELECT u.*, a.enclosing FROM uses u JOIN around a
    ON a.repo = u.repo AND a.doc = u.doc AND a.line = u.line AND a.ch = u.ch),
stated AS (
  SELECT repo, symbol, 'ext npm lib 1 x/' || p_type || '#' AS target, path, start_line AS line
  FROM known WHERE p_size = 1)"""
_ID = "md5(repo || chr(0) || {})"

QUERIES = {
    "targets_by_symbol": (targets_by_symbol,
                          f"WITH {V.SYMBOLS}, {_by_symbol_sql('ECONOMY')} SELECT * FROM targets"),
    "targets_whole_file": (targets_whole_file, f"""WITH {V.SYMBOLS}
SELECT * FROM symbols WHERE path = 'src/3.rs'"""),
    "targets_by_path_innermost": (targets_by_path_innermost,
                                  f"WITH {V.SYMBOLS}, {_by_path_sql(20, 40)} SELECT * FROM targets"),
    "impl_hop": (impl_hop, f"WITH {V.SYMBOLS}, {V.REFS}, {_by_path_sql(20, 21)}, {_HOP} SELECT * FROM hop"),
    "callers_topk": (callers_topk, _callers_sql(_by_symbol_sql("ECONOMY", "Brand#11"), 30)),
    "callers_of_path": (callers_of_path, _callers_sql(_by_path_sql(20, 21), None)),
    "callers_file_scope": (callers_file_scope, f"""WITH {V.SYMBOLS}, {V.REFS}, {_by_symbol_sql('SMALL', 'Brand#4')}
SELECT DISTINCT repo || '/' || path || ':' || line AS location, '(file scope)' AS enclosing
FROM refs WHERE enclosing_symbol_id IS NULL AND symbol_id IN (SELECT id FROM targets)"""),
    "enclosing_stab": (enclosing_stab, f"""WITH {V.SYMBOLS}, points AS (
  SELECT o_orderkey, 'src/' || (o_orderkey % 20) || '.rs' AS path, o_custkey % 100 AS line,
         o_orderkey % 17 AS ch FROM orders)
SELECT o_orderkey, s.id AS enclosing FROM points p LEFT JOIN symbols s
  ON s.path = p.path AND (s.start_line, s.id % 11) <= (p.line, p.ch)
     AND (p.line, p.ch) <= (s.end_line, s.id % 13)
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY s.start_line DESC, s.id % 11 DESC,
     s.end_line, s.id % 13, s.id DESC) = 1"""),
    "shared_body_slices": (shared_body_slices, f"""WITH {V.SCIP}
SELECT repo, CAST(doc AS INTEGER) AS doc, symbol, CAST(s_line AS INTEGER) AS s_line, CAST(s_ch AS INTEGER) AS s_ch,
       CAST(e_line AS INTEGER) AS e_line, CAST(e_ch AS INTEGER) AS e_ch FROM slices"""),
    "descriptors_parse": (descriptors_parse, f"""WITH {V.SCIP}
SELECT symbol, 'm=namespace|' || CASE p_partkey % 3
  WHEN 0 THEN 'impl=type|T' || p_partkey || '=type_parameter|' || p_type || '=type_parameter|' || replace(p_name, ' ', '_') || '=method'
  WHEN 1 THEN p_type || '=type|' || replace(p_name, ' ', '_') || '=method'
  ELSE p_name || chr(96) || p_partkey || '.ts=namespace|C=type|value=term' END AS parts FROM defs"""),
    "kind_lookup": (kind_lookup, f"""SELECT p_partkey, coalesce({_KINDS}[p_partkey % 90], 'unknown') AS kind FROM part"""),
    "symbol_intern_last_wins": (symbol_intern_last_wins, """WITH d AS (
  SELECT 'org/' || (o_custkey % 5) AS repo, 't cargo d 1 m/C' || o_custkey || '#run().' AS scip_symbol,
         o_orderpriority AS name, 'method' AS kind, 'src/' || o_orderkey || '.rs' AS path,
         CAST(o_orderkey % 90 AS INTEGER) AS start_line, CAST(o_orderkey % 90 + 5 AS INTEGER) AS end_line
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
m AS (SELECT DISTINCT 'org/' || (l_partkey % 5) AS repo, 't cargo d 1 m/C' || l_partkey || '#run().' AS scip_symbol
      FROM lineitem)
SELECT md5(repo || chr(0) || scip_symbol) AS id, * FROM (
  SELECT * FROM d UNION ALL
  SELECT repo, scip_symbol, 'run', 'method', NULL, NULL, NULL FROM m
  WHERE scip_symbol NOT IN (SELECT scip_symbol FROM d))"""),
    "scip_symbols": (scip_symbols, f"""WITH {_GRAPH}
SELECT {_ID.format('symbol')} AS id, repo, symbol AS scip_symbol, name, kind, path, start_line, end_line FROM known
UNION ALL SELECT DISTINCT {_ID.format('target')}, repo, target, split_part(split_part(target, '/', 2), '#', 1), 'type',
       NULL, NULL, NULL FROM stated"""),
    "scip_refs": (scip_refs, f"""WITH {_GRAPH}
SELECT {_ID.format('symbol')} AS symbol_id, repo, path, CAST(line + 1 AS INTEGER) AS line,
       {_ID.format('enclosing')} AS enclosing_symbol_id, 'reference' AS role FROM calls
UNION ALL SELECT {_ID.format('target')}, repo, path, line, {_ID.format('symbol')}, 'type_definition' FROM stated
UNION ALL SELECT {_ID.format('target')}, repo, path, line, {_ID.format('symbol')}, 'implementation'
FROM derived WHERE target IS NOT NULL"""),
    "scip_from_documents": (scip_from_documents, f"""WITH {_GRAPH}
SELECT {_ID.format('symbol')} AS symbol_id, repo, path, CAST(line + 1 AS INTEGER) AS line,
       {_ID.format('enclosing')} AS enclosing_symbol_id, 'reference' AS role FROM calls
UNION ALL SELECT {_ID.format('target')}, repo, path, line, {_ID.format('symbol')}, unnest(['type_definition', 'implementation']) FROM stated
UNION ALL SELECT {_ID.format('target')}, repo, path, line, {_ID.format('symbol')}, 'implementation'
FROM derived WHERE target IS NOT NULL"""),
    "find_callers_full": (find_callers_full, _callers_sql(_by_symbol_sql("ECONOMY", "Brand#11"), None)
                          .removesuffix("\nSELECT * FROM sites") + _FULL),
    "scip_stats": (scip_stats, f"""WITH {_GRAPH}, r AS (SELECT DISTINCT repo FROM defs)
SELECT repo, (SELECT count(DISTINCT doc) FROM defs d WHERE d.repo = r.repo) AS documents,
  (SELECT count(*) FROM known k WHERE k.repo = r.repo)
    + (SELECT count(DISTINCT target) FROM stated s WHERE s.repo = r.repo) AS symbols,
  (SELECT count(*) FROM calls c WHERE c.repo = r.repo) AS refs,
  (SELECT count(*) FROM calls c WHERE c.repo = r.repo AND enclosing IS NULL) AS refs_unresolved,
  (SELECT count(*) FROM stated s WHERE s.repo = r.repo)
    + (SELECT count(*) FROM derived x WHERE x.repo = r.repo AND target IS NOT NULL) AS relationships,
  (SELECT count(*) FROM derived x WHERE x.repo = r.repo AND target IS NULL) AS impl_trait_not_local
FROM r"""),
    "impl_edges_unique": (impl_edges_unique, f"""WITH {_GRAPH}
SELECT repo, symbol, path, line, trait, member, target FROM derived"""),
}
