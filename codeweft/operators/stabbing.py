"""Innermost enclosing interval of every position, without pairing positions and intervals.

Both axes (line, character) are covered by a fixed family of aligned blocks of 16^level
positions. Intervals are ranked once, so that the better of two is a greater number. An
interval is written as the few blocks that tile it exactly, and only the best rank per block
survives the pre-aggregation, which hashes and never sorts the blocks. A position then looks
up the one block per level it lies in and keeps the best rank. Work is linear in the rows
times the number of levels however the intervals nest, cross or pile up.

Best means: greatest start, then smallest end, then last in order; both ends count as inside.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import END_OF_LINE
from ..session import cut
from .ordering import global_rank, rank_in_group

_RADIX_BITS = 4


def _levels(highest: int) -> int:
    n = 1
    while (highest >> (_RADIX_BITS * n)) > 0 and n < 8:
        n += 1
    return n


def _tiles(lo: Column, hi: Column, levels: int) -> Column:
    """array<struct<level, node>> of aligned blocks that exactly tile lo..hi."""
    end = hi.cast("long") + 1
    nothing = F.array().cast("array<bigint>")

    def bounds(level):
        size = 1 << (_RADIX_BITS * level)
        return (F.floor((lo.cast("long") + (size - 1)) / F.lit(float(size))).cast("long"),
                F.floor(end / F.lit(float(size))).cast("long"))

    def run(a, b):
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(nothing)

    def tile_of(level):
        return lambda x: F.struct(F.lit(level).alias("level"), x.alias("node"))

    out = []
    for level in range(levels):
        a, b = bounds(level)
        if level + 1 < levels:
            up_a, up_b = bounds(level + 1)
            split = F.concat(run(a, up_a * 16), run(up_b * 16, b))
            nodes = F.when(up_a < up_b, split).otherwise(run(a, b))
        else:
            nodes = run(a, b)
        out.append(F.transform(nodes, tile_of(level)))
    return F.concat(*out)


def _probes(on: Column, pos: Column, levels: int) -> list[Column]:
    """The one block per level that holds `pos`."""
    return [F.struct(on.cast("int").alias("on"), F.lit(lv).alias("level"),
                     F.shiftright(pos.cast("long"), _RADIX_BITS * lv).alias("node"))
            for lv in range(levels)]


def resolve_enclosing(points: DataFrame, intervals: DataFrame, doc: list[str],
                      payload: str) -> DataFrame:
    """points(doc..., line, ch) -> distinct positions with `payload` (NULL: not enclosed).

    intervals(doc..., s_line, s_ch, e_line, e_ch, ordinal, payload).
    """
    at = cut(points.select(*doc, "line", "ch").distinct())
    top = at.agg(F.max("line").alias("l"), F.max("ch").alias("c")).first()
    if top["l"] is None:
        return at.withColumn(payload, F.lit(None).cast(intervals.schema[payload].dataType))
    max_line, max_ch = top["l"], top["c"]
    line_levels, ch_levels = _levels(max_line), _levels(max_ch)

    valid = (intervals.where(F.struct("s_line", "s_ch") <= F.struct("e_line", "e_ch"))
             .select(*doc, "s_line", "s_ch", "e_line", "e_ch", (-F.col("e_line")).alias("_ne_line"),
                     (-F.col("e_ch")).alias("_ne_ch"), "ordinal", F.col(payload).alias("_payload")))
    ranked = cut(global_rank(valid, "s_line", "s_ch", "_ne_line", "_ne_ch", "ordinal", "_payload", name="_best"))
    multi = F.col("s_line") < F.col("e_line")
    # Nothing past the last position can be asked for, so ranges are clipped there.
    last_line, last_ch = F.lit(max_line), F.lit(max_ch)
    whole_line = F.lit(-1)
    pieces = F.array(
        F.struct(F.when(multi, whole_line).alias("on"), (F.col("s_line") + 1).alias("lo"),
                 F.least(F.col("e_line") - 1, last_line).alias("hi")),
        F.struct(F.when(multi, F.col("s_line")).alias("on"), F.col("s_ch").alias("lo"),
                 last_ch.alias("hi")),
        F.struct(F.when(multi, F.col("e_line")).alias("on"), F.lit(0).alias("lo"),
                 F.least(F.col("e_ch"), last_ch).alias("hi")),
        F.struct(F.when(~multi, F.col("s_line")).alias("on"), F.col("s_ch").alias("lo"),
                 F.least(F.col("e_ch"), last_ch).alias("hi")))
    pieces = F.filter(pieces, lambda p: p["on"].isNotNull() & (p["lo"] <= p["hi"])
                      & (p["on"] <= last_line))
    tiled = F.flatten(F.transform(pieces, lambda p: F.transform(
        F.when(p["on"] < 0, _tiles(p["lo"], p["hi"], line_levels))
         .otherwise(_tiles(p["lo"], p["hi"], ch_levels)),
        lambda t: F.struct(p["on"].alias("on"), t["level"].alias("level"),
                           t["node"].alias("node")))))
    nodes = (ranked.select(*doc, "_best", F.explode(tiled).alias("t"))
             .groupBy(*doc, F.col("t.on").alias("on"), F.col("t.level").alias("level"),
                      F.col("t.node").alias("node"))
             .agg(F.max("_best").alias("_best")))

    probes = F.array(*_probes(whole_line, F.col("line"), line_levels),
                     *_probes(F.col("line"), F.col("ch"), ch_levels))
    asked = (at.select(*doc, "line", "ch", F.explode(probes).alias("t"))
             .select(*doc, "line", "ch", "t.on", "t.level", "t.node"))
    found = (asked.join(nodes, [*doc, "on", "level", "node"], "left")
             .groupBy(*doc, "line", "ch").agg(F.max("_best").alias("_best")))
    return (found.join(ranked.select("_best", F.col("_payload").alias(payload)), "_best", "left")
            .select(*doc, "line", "ch", payload))


# Members of one shared range that a single window may order.
MAX_SIBLINGS = 100_000


def split_shared_bodies(bodies: DataFrame, doc: list[str], max_siblings: int = MAX_SIBLINGS) -> DataFrame:
    """Own slice for every definition that shares its body range with siblings.

    bodies(doc..., symbol, ordinal, s_line, s_ch, e_line, e_ch, n_line, n_ch): a member of a
    shared range owns from its own name to the line before the next member's name; the last
    one keeps the common end. Unshared bodies are never ordered. Where a range has too many
    members for one task they are ranked across tasks and joined to their successor.
    """
    rng = [*doc, "s_line", "s_ch", "e_line", "e_ch"]
    sizes = bodies.groupBy(*rng).agg(F.count("*").alias("_n"), F.min("ordinal").alias("_first"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    sized = bodies.join(sizes, rng)
    alone = sized.where("_n = 1").select(
        *doc, "symbol", "s_line", "s_ch", "e_line", "e_ch",
        F.struct(F.col("_first").alias("first"), F.lit(0).cast("long").alias("member")).alias("ordinal"))
    shared = sized.where("_n > 1")
    order = ["n_line", "n_ch", "ordinal"]
    if largest <= max_siblings:
        w = W.partitionBy(*rng).orderBy(*order)
        ranked = shared.withColumn("_next", F.lead("n_line").over(w)) \
                       .withColumn("_member", F.row_number().over(w).cast("long"))
    else:
        placed = cut(rank_in_group(shared, rng, order, "_member"))
        after = placed.select(*rng, (F.col("_member") - 1).alias("_member"), F.col("n_line").alias("_next"))
        ranked = placed.join(after, [*rng, "_member"], "left")
    last = F.col("_next").isNull()
    sliced = ranked.select(
        *doc, "symbol", F.col("n_line").alias("s_line"), F.col("n_ch").alias("s_ch"),
        F.when(last, F.col("e_line")).otherwise(F.greatest(F.col("_next") - 1, F.col("n_line"))).alias("e_line"),
        F.when(last, F.col("e_ch")).otherwise(F.lit(END_OF_LINE)).alias("e_ch"),
        F.struct(F.col("_first").alias("first"), F.col("_member").alias("member")).alias("ordinal"))
    return alone.unionByName(sliced)
