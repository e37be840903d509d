"""SCIP symbol strings and ranges as column expressions.

A symbol's descriptor tail is cut into contiguous pieces with one anchored regular
expression (each match must begin where the previous one ended, so an unterminated
bracket ends the list), then every piece is read on its own.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K

_QUOTED = r"`(?:[^`]|``)*+`"
_PLAIN = r"(?![`\[(])[^/#.:!(\[]*+"
_PIECE = (r"(?s)\G(?:\[[^\]]*\]|\([^)]*\)"
          rf"|(?:{_QUOTED}|{_PLAIN})(?:\([^)]*\)\.?|[^(]))")
_QUOTED_PARTS = r"(?s)^`((?:[^`]|``)*+)`(.*)$"
_PLAIN_PARTS = r"(?s)^([^/#.:!(\[]*+)(.*)$"


def _read_piece(piece: Column) -> Column:
    head = F.substring(piece, 1, 1)
    inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
    quoted = head == "`"
    name = F.when(quoted, F.replace(F.regexp_extract(piece, _QUOTED_PARTS, 1),
                                    F.lit("``"), F.lit("`"))) \
            .otherwise(F.regexp_extract(piece, _PLAIN_PARTS, 1))
    tail = F.when(quoted, F.regexp_extract(piece, _QUOTED_PARTS, 2)) \
            .otherwise(F.regexp_extract(piece, _PLAIN_PARTS, 2))
    sigil = F.create_map(*[F.lit(x) for kv in K.SIGIL_KINDS.items() for x in kv])
    kind = F.when(tail.startswith("("), F.lit("method")) \
            .otherwise(F.try_element_at(sigil, tail))
    return (F.when(head == "[", F.struct(inner.alias("name"), F.lit("type_parameter").alias("kind")))
            .when(head == "(", F.struct(inner.alias("name"), F.lit("parameter").alias("kind")))
            .otherwise(F.struct(name.alias("name"), kind.alias("kind"))))


def descriptors(symbol: Column) -> Column:
    """array<struct<name, kind>> of a symbol; empty when it has no descriptor tail."""
    tail = F.coalesce(F.try_element_at(F.split(symbol, " ", 5), F.lit(5)), F.lit(""))
    pieces = F.regexp_extract_all(tail, F.lit(_PIECE), F.lit(0))
    return F.filter(F.transform(pieces, _read_piece), lambda d: d["kind"].isNotNull())


def _last(parsed: Column, field: str) -> Column:
    return F.try_element_at(parsed, F.lit(-1))[field]


def symbol_name(symbol: Column, parsed: Column, display_name: Column | None = None) -> Column:
    fallback = F.coalesce(_last(parsed, "name"), symbol)
    if display_name is None:
        return fallback
    return F.coalesce(F.nullif(display_name, F.lit("")), fallback)


def symbol_kind(parsed: Column, code: Column | None = None) -> Column:
    fallback = F.coalesce(_last(parsed, "kind"), F.lit("unknown"))
    if code is None:
        return fallback
    return F.coalesce(kind_name(code), fallback)


def kind_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.SYMBOL_KINDS.items() for x in kv])
    return F.try_element_at(table, code)


def span_start(rng: Column) -> Column:
    return F.struct(rng[0].alias("line"), rng[1].alias("ch"))


def span_end(rng: Column) -> Column:
    """End of a range; the three-number form stays on its start line."""
    short = F.size(rng) == 3
    return F.struct(
        F.when(short, rng[0]).otherwise(rng[2]).alias("line"),
        F.when(short, rng[2]).otherwise(F.try_element_at(rng, F.lit(4))).alias("ch"))


def symbol_id(repo: Column, symbol: Column) -> Column:
    """Stable 128-bit id of a symbol; the same across re-ingests and never joined for."""
    return F.md5(F.concat(repo, F.lit("\0"), symbol))
