"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Spans come from one projection per row: the pieces between matches (split) and the matches
themselves (regexp_extract_all) give every offset. Only hashes of candidate values, with their
repository and owner, are shuffled: they are counted as distinct (hash, owner, repository), then
as distinct (hash, owner), each with partial sums, so a value copied into a third of all
documents stays a few rows per task. Values found under many owners are copied examples; values
of one owner are treated as live."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .text import bound, fresh, running_starts

# Fixed patterns: kind, pattern, group that holds the value, least length of that group.
BASE = (
    ("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),       # a run of 32 or more is a maximal run that passes
)
EXTRA = (
    ("vendor", "\\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"
               "|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 1),
    ("jwt", "\\beyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("pem", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 1),
)
KINDS = BASE + EXTRA
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, rank, end, kind, value) of one kind; offsets in code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # the last gap has no match after it
    rows = F.filter(F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("gap")),
                    lambda r: r["m"].isNotNull())

    def placed(rows: Column) -> Column:
        starts = running_starts(F.transform(rows, lambda r: F.length(r["gap"]) + F.length(r["m"])))
        spans = F.zip_with(rows, starts, lambda r, s: F.struct(
            (s + F.length(r["gap"])).alias("start"), F.lit(rank).alias("rank"),
            (s + F.length(r["gap"]) + F.length(r["m"])).alias("end"), F.lit(kind).alias("kind"), r["v"].alias("value")))
        return F.filter(spans, lambda s: F.length(s["value"]) >= least)

    return F.when(text.rlike(pattern), bound(rows, placed)).otherwise(F.array().cast(SPAN))


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus `spans`: every span of every kind, by start, then kind in the order of KINDS.
    A null or empty text has none. One row in, one row out; other columns pass through, but one called
    spans is replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts = fresh(docs.columns, *(k for k, *_ in KINDS))
    for rank, (name, kind) in enumerate(zip(parts, KINDS)):
        docs = docs.withColumn(name, _spans(body, rank, *kind))
    return docs.withColumn("spans", F.array_sort(F.concat(*parts))).drop(*parts)


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """(secret, n_owners, n_repositories) of every candidate value, by its SHA-256.

    `found` has `spans`. A null owner or repository counts as one of its own."""
    one = (found.select(F.col(owner).alias("o"), F.col(repository).alias("r"), F.explode("spans.value").alias("v"))
           .select(F.sha2("v", 256).alias("secret"), "o", "r").groupBy("secret", "o", "r").agg(F.lit(1)))
    per_owner = one.groupBy("secret", "o").agg(F.count("*").alias("n"))
    return per_owner.groupBy("secret").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", text: str = "text",
         max_live_owners: int = 1, max_live_repositories: int = 3) -> DataFrame:
    """`docs` without its text, plus `spans` (each with secret, n_owners, n_repositories, live).

    A value is live-looking if at most `max_live_owners` owners and `max_live_repositories`
    repositories hold it, else it is a widely copied example. Rows without spans never shuffle;
    repeated rows are kept and count once per (owner, repository). A column called spans is replaced.
    Empty tables give no rows."""
    row, one = fresh([*docs.columns, "spans"], "row", "one")
    # texts are read and matched once; what is written is narrow, and rows get a number of their own
    found = cut(find_spans(docs, text).drop(text).withColumn(row, F.monotonically_increasing_id()))
    some, none = found.where("size(spans) > 0"), found.where("size(spans) = 0 or spans is null")
    counts = ownership(some, owner, repository)
    each = (some.select(F.col(row), F.explode("spans").alias(one))
            .withColumn("secret", F.sha2(F.col(f"{one}.value"), 256)).join(counts, "secret")
            .select(row, F.struct(
                f"{one}.start", f"{one}.rank", f"{one}.end", f"{one}.kind", "secret", "n_owners", "n_repositories",
                ((F.col("n_owners") <= max_live_owners) & (F.col("n_repositories") <= max_live_repositories))
                .alias("live")).alias(one)))
    ranked = each.groupBy(row).agg(F.array_sort(F.collect_list(one)).alias("spans"))
    return (some.drop("spans").join(ranked, row)
            .unionByName(none.withColumn("spans", F.array().cast(ranked.schema["spans"].dataType))).drop(row))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = scan(docs)
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return out.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"))


def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind in DuckDB, which also lacks match positions: the text is walked match by match."""
    return f"""
    SELECT doc_id, '{kind}' AS kind, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS s,
           length(m[i]) AS n, v[i] AS v FROM (
      SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v,
               string_split_regex(t, '{pattern}') AS g FROM d)) WHERE length(v[i]) >= {least}"""


OP4_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS (""" + " UNION ALL ".join(_sql_spans(k, p.replace("'", "''").replace("\\x20", " "), g, n) for k, p, g, n in KINDS) + """),
k AS (SELECT *, list_position(['assign', 'access', 'hex', 'vendor', 'jwt', 'pem'], kind) AS r,
             kind || ':' || s || ':' || (s + n) AS shown FROM f),
o AS (SELECT v, count(DISTINCT coalesce(source, '?')) AS n_owners, count(DISTINCT (coalesce(source, '?'), doc_id)) AS n_repos
      FROM k JOIN d USING (doc_id) GROUP BY v),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(shown, ',' ORDER BY s, r) FILTER (r <= 3) AS base, string_agg(shown, ',' ORDER BY s, r) AS spans,
             count(*) FILTER (n_owners <= 1 AND n_repos <= 3) AS n_live,
             count(*) FILTER (NOT (n_owners <= 1 AND n_repos <= 3)) AS n_copied
      FROM k JOIN o USING (v) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN a USING (doc_id)"""
