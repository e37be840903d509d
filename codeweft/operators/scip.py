"""SCIP documents to the call graph: symbols, references and implementation edges.

Input is three flat frames (see `flatten_documents`), so a document is never handled as a
whole after the read. `at` orders occurrences inside one repository: (document, position).
"""
from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import scip_symbols as S
from ..session import cut
from .ordering import carry_forward
from .stabbing import resolve_enclosing, split_shared_bodies


@dataclass
class Flat:
    """occurrences(repo, path, doc, pos, symbol, is_def, has_body, s/e_line, s/e_ch, n_line, n_ch)
    infos(repo, doc, pos, symbol, kind, display_name)
    relations(repo, path, doc, symbol, target, role)
    documents(repo, n)."""
    occurrences: DataFrame
    infos: DataFrame
    relations: DataFrame
    documents: DataFrame


def flatten_documents(docs: DataFrame) -> Flat:
    """docs(repo, doc, relative_path, symbols, occurrences) -> flat frames. Symbols, with their relationships,
    are written once, so that the documents are not parsed again for every use of them."""
    path = F.coalesce("relative_path", F.lit("")).alias("path")
    o, rng, body = F.col("o"), F.col("o.range"), F.col("o.enclosing_range")
    has_body = F.coalesce(F.size(body) > 0, F.lit(False))
    occurrences = (
        docs.select("repo", "doc", path, F.posexplode("occurrences").alias("pos", "o"))
        .where(~o["symbol"].startswith("local "))
        .withColumn("_b", F.when(has_body, body).otherwise(rng))
        .select("repo", "path", "doc", "pos", o["symbol"].alias("symbol"),
                (F.coalesce(o["symbol_roles"], F.lit(0)).bitwiseAND(K.DEFINITION_ROLE) != 0)
                .alias("is_def"),
                has_body.alias("has_body"),
                S.span_start(F.col("_b"))["line"].alias("s_line"),
                S.span_start(F.col("_b"))["ch"].alias("s_ch"),
                S.span_end(F.col("_b"))["line"].alias("e_line"),
                S.span_end(F.col("_b"))["ch"].alias("e_ch"),
                rng[0].alias("n_line"), rng[1].alias("n_ch")))
    infos = cut(docs.select("repo", "doc", path, F.posexplode("symbols").alias("pos", "s"))
                .select("repo", "path", "doc", "pos", "s.*"))
    relations = (infos.select("repo", "path", "doc", "symbol", F.explode("relationships").alias("r"))
                 .select("repo", "path", "doc", "symbol", F.col("r.symbol").alias("target"),
                         F.explode(F.filter(F.array(
                             F.when(F.col("r.is_implementation"), "implementation"),
                             F.when(F.col("r.is_type_definition"), "type_definition")),
                             lambda x: x.isNotNull())).alias("role")))
    return Flat(occurrences, infos.select("repo", "doc", "pos", "symbol", "kind", "display_name"),
                relations, docs.groupBy("repo").agg(F.count("*").alias("n")))


def body_slices(occurrences: DataFrame) -> DataFrame:
    """Intervals that may enclose references: definition bodies, siblings sliced apart."""
    bodies = occurrences.where("is_def AND has_body").withColumnRenamed("pos", "ordinal")
    return split_shared_bodies(bodies, ["repo", "doc"])


def references(occurrences: DataFrame, slices: DataFrame) -> DataFrame:
    """Every non-definition occurrence with the innermost definition around it.

    Only the distinct positions are resolved and kept, with the id of what encloses them; the occurrences join
    them by position.
    """
    points = (occurrences.where("NOT is_def")
              .select("repo", "path", "doc", "symbol",
                      F.col("n_line").alias("line"), F.col("n_ch").alias("ch")))
    around = cut(resolve_enclosing(points, slices.withColumnRenamed("symbol", "enclosing"),
                                   ["repo", "doc"], "enclosing")) \
        .withColumn("enclosing_id", S.symbol_id(F.col("repo"), F.col("enclosing")))
    return points.join(around, ["repo", "doc", "line", "ch"], "left")


def _last(value: Column, order: Column) -> Column:
    return F.max_by(value, order)


def definitions(flat: Flat, slices: DataFrame) -> DataFrame:
    """One row per (repo, symbol, document) that defines it: what that document leaves behind.

    The last definition wins; where the symbol owns a slice, the slice gives the lines.
    """
    infos = (flat.infos.groupBy("repo", "doc", "symbol")
             .agg(_last(F.struct("kind", "display_name"), F.col("pos")).alias("info")))
    last = (flat.occurrences.where("is_def").groupBy("repo", "doc", "symbol")
            .agg(_last(F.struct("path", "s_line", "e_line"), F.col("pos")).alias("d")))
    cutout = (slices.groupBy("repo", "doc", "symbol")
              .agg(_last(F.struct("s_line", "e_line"), F.col("ordinal")).alias("c")))
    return (last.join(infos, ["repo", "doc", "symbol"], "left")
            .join(cutout, ["repo", "doc", "symbol"], "left")
            .select("repo", "doc", "symbol", "info.display_name", F.col("info.kind").alias("code"),
                    F.col("d.path").alias("path"),
                    (F.coalesce("c.s_line", "d.s_line") + 1).alias("start_line"),
                    (F.coalesce("c.e_line", "d.e_line") + 1).alias("end_line")))


def intern_symbols(defined: DataFrame, mentioned: DataFrame, parsed: bool = False) -> DataFrame:
    """One row per (repo, symbol); symbols only mentioned keep NULL path and lines.

    Names and kinds come from the symbol string, which is read here, once per symbol;
    `parsed` keeps what was read as `_d`.
    """
    state = F.struct("display_name", "code", "path", "start_line", "end_line")
    latest = defined.select("repo", "symbol", F.col("doc").cast("long").alias("o"), state.alias("s"))
    named = mentioned.select("repo", "symbol", F.lit(None).cast("long").alias("o"),
                             F.lit(None).cast(latest.schema["s"].dataType).alias("s"))
    merged = (latest.unionByName(named)
              .groupBy("repo", "symbol").agg(_last(F.col("s"), F.col("o")).alias("s"))
              .withColumn("_d", S.descriptors(F.col("symbol"))))
    return merged.select(
        S.symbol_id(F.col("repo"), F.col("symbol")).alias("id"), "repo",
        F.col("symbol").alias("scip_symbol"),
        S.symbol_name(F.col("symbol"), F.col("_d"), F.col("s.display_name")).alias("name"),
        S.symbol_kind(F.col("_d"), F.col("s.code")).alias("kind"),
        "s.path", "s.start_line", "s.end_line", *(["_d"] if parsed else []))


def classify_members(symbols: DataFrame) -> DataFrame:
    """Defined methods with the type they belong to, and the trait where the name states one."""
    parsed = symbols.where("path IS NOT NULL")
    if "_d" not in parsed.columns:
        parsed = parsed.withColumn("_d", S.descriptors(F.col("scip_symbol")))
    head = F.slice("_d", F.lit(1), F.greatest(F.size("_d") - 1, F.lit(0)))

    def names(kind):
        return F.transform(F.filter(head, lambda d: d["kind"] == kind), lambda d: d["name"])

    params, owners = names("type_parameter"), names("type")
    in_impl = F.array_contains(owners, "impl") & (F.size(params) >= 2)
    return (parsed.where(F.try_element_at("_d", F.lit(-1))["kind"] == "method")
            .select("repo", "scip_symbol", "path", "start_line",
                    F.try_element_at("_d", F.lit(-1))["name"].alias("member"),
                    F.when(in_impl, F.try_element_at(params, F.lit(-1))).alias("trait"),
                    F.when(~in_impl, F.try_element_at(owners, F.lit(-1))).alias("owner")))


def derive_impl_edges(symbols: DataFrame) -> DataFrame:
    """impl [Type][Trait] members with the one local method they implement.

    `target` is NULL where the trait is not local or the method is ambiguous.
    """
    members = classify_members(symbols)
    unique = (members.where("owner IS NOT NULL").groupBy("repo", F.col("owner").alias("trait"), "member")
              .agg(F.count("*").alias("n"), F.min("scip_symbol").alias("target"))
              .where("n = 1").drop("n"))
    return (members.where("trait IS NOT NULL")
            .join(unique, ["repo", "trait", "member"], "left")
            .select("repo", F.col("scip_symbol").alias("symbol"), "path",
                    F.col("start_line").alias("line"), "trait", "member", "target"))


def relation_refs(relations: DataFrame, defined: DataFrame) -> DataFrame:
    """Stated relationships; path and line as the implementing symbol stood at that document."""
    asked = relations.select("repo", "symbol", "doc").distinct()
    state = F.struct("path", F.col("start_line").alias("line"))
    known = defined.select("repo", "symbol", "doc", state.alias("s"))
    as_of = carry_forward(asked.join(known, ["repo", "symbol", "doc"], "full"),
                          ["repo", "symbol"], "doc", "s")
    return (relations.drop("path").join(as_of, ["repo", "symbol", "doc"], "left")
            .select("repo", "symbol", "target", "role", "s.path", "s.line"))


class Graph:
    """The whole graph of the repositories in a Flat. Every part is worked out when it is first asked
    for, and what several need is written once: symbols alone never resolve a reference."""

    def __init__(self, flat: Flat):
        self._given = flat

    @cached_property
    def flat(self) -> Flat:
        return replace(self._given, occurrences=cut(self._given.occurrences))

    @cached_property
    def _definitions(self) -> Flat:
        """The few occurrences that define: what needs only these does not read all the others."""
        return replace(self.flat, occurrences=cut(self.flat.occurrences.where("is_def")))

    @cached_property
    def slices(self) -> DataFrame:
        return cut(body_slices(self._definitions.occurrences))

    @cached_property
    def calls(self) -> DataFrame:
        return references(self.flat.occurrences, self.slices)

    @cached_property
    def defined(self) -> DataFrame:
        return cut(definitions(self._definitions, self.slices))

    @cached_property
    def _parsed(self) -> DataFrame:
        """Symbols with a definition; edges need no others, so they do not ask what all occurrences mention."""
        return cut(intern_symbols(self.defined, self.defined.select("repo", "symbol").where("false"), parsed=True))

    @cached_property
    def symbols(self) -> DataFrame:
        flat = self.flat
        mentioned = (flat.occurrences.where("NOT is_def").select("repo", "symbol").distinct()
                     .unionByName(flat.relations.select("repo", "symbol"))
                     .unionByName(flat.relations.select("repo", F.col("target").alias("symbol"))))
        only = mentioned.join(self.defined.select("repo", "symbol"), ["repo", "symbol"], "left_anti")
        return self._parsed.drop("_d").unionByName(cut(intern_symbols(self.defined.where("false"), only)))

    @cached_property
    def stated(self) -> DataFrame:
        return relation_refs(self.flat.relations, self.defined)

    @cached_property
    def derived(self) -> DataFrame:
        return derive_impl_edges(self._parsed)

    @cached_property
    def refs(self) -> DataFrame:
        def rows(df, symbol, enclosing_id, role):
            return df.select(S.symbol_id(F.col("repo"), F.col(symbol)).alias("symbol_id"), "repo",
                             "path", F.col("line").cast("int").alias("line"),
                             enclosing_id.alias("enclosing_symbol_id"), role.alias("role"))

        own = S.symbol_id(F.col("repo"), F.col("symbol"))
        return (rows(self.calls.withColumn("line", F.col("line") + 1), "symbol", F.col("enclosing_id"), F.lit("reference"))
                .unionByName(rows(self.stated, "target", own, F.col("role")))
                .unionByName(rows(self.derived.where("target IS NOT NULL"), "target", own, F.lit("implementation"))))

    @cached_property
    def stats(self) -> DataFrame:
        return _stats(self.flat, self.symbols, self.calls, self.stated, self.derived)


def ingest(flat: Flat) -> Graph:
    return Graph(flat)


def _stats(flat: Flat, symbols, calls, stated, derived) -> DataFrame:
    def tagged(df, **cols):
        names = ["documents", "symbols", "refs", "refs_unresolved", "relationships",
                 "impl_trait_not_local"]
        return df.select("repo", *[cols.get(n, F.lit(0)).cast("long").alias(n) for n in names])

    one = F.lit(1)
    parts = [tagged(flat.documents, documents=F.col("n")),
             tagged(symbols, symbols=one),
             tagged(calls, refs=one, refs_unresolved=F.col("enclosing").isNull().cast("int")),
             tagged(stated, relationships=one),
             tagged(derived, relationships=F.col("target").isNotNull().cast("int"),
                    impl_trait_not_local=F.col("target").isNull().cast("int"))]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy("repo").agg(*[F.sum(c).alias(c) for c in merged.columns if c != "repo"])
