"""Files to chunks: captured definitions plus line windows over everything between them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import text as T
from .syntax import syntax_spans

_STRIDE = K.WINDOW_LINES - K.WINDOW_OVERLAP


def _joined(lines: Column, first: Column, last: Column) -> Column:
    """Lines first..last (0-based, inclusive) as text."""
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def windows(lines: Column, first: Column, last: Column, min_lines: int = 1) -> Column:
    """Overlapping windows over lines first..last that hold `min_lines` non-blank lines or more; by
    default only blank ones are left out, so that every line with text is in some window."""
    rest = F.greatest(last - first + 1 - K.WINDOW_LINES, F.lit(0))
    steps = F.sequence(F.lit(0), F.ceil(rest / F.lit(float(_STRIDE))).cast("int"))

    def window(i: Column) -> Column:
        start = first + i * _STRIDE
        end = F.least(start + (K.WINDOW_LINES - 1), last)
        filled = F.size(F.filter(F.slice(lines, start + 1, end - start + 1),
                                 lambda ln: ln.rlike(r"(?U)\S")))
        return F.struct((start + 1).cast("int").alias("start_line"),
                        (end + 1).cast("int").alias("end_line"),
                        F.lit("").alias("symbol"),
                        _joined(lines, start, end).alias("text"),
                        filled.alias("filled"))

    kept = F.filter(F.transform(steps, window), lambda w: w["filled"] >= min_lines)
    return F.transform(kept, lambda w: F.struct(w["start_line"], w["end_line"],
                                                w["symbol"], w["text"]))


def line_windows(files: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row per line window of every text; the line array never leaves its row."""
    split = files.select(*keep, F.split(F.col(text), "\n", -1).alias("_lines"))
    lines = F.col("_lines")
    return (split.select(*keep, F.explode(windows(lines, F.lit(0), F.size(lines) - 1)).alias("_w"))
            .select(*keep, "_w.start_line", "_w.end_line", "_w.symbol", "_w.text"))


def _segments(spans: Column, n_lines: Column) -> Column:
    """Definitions and the gaps around them, in file order.

    A span is kept when it ends past everything seen so far, so it may overlap the one
    before it; a gap is whatever lies between the covered part and the next span.
    """
    shape = "struct<until:int,out:array<struct<gap:boolean,first:int,last:int,symbol:string>>>"

    def seg(gap, first, last, symbol):
        return F.struct(F.lit(gap).alias("gap"), first.cast("int").alias("first"),
                        last.cast("int").alias("last"), symbol.alias("symbol"))

    none = F.array().cast("array<struct<gap:boolean,first:int,last:int,symbol:string>>")

    def step(acc: Column, s: Column) -> Column:
        before = F.when(s["start"] > acc["until"] + 1,
                        F.array(seg(True, acc["until"] + 1, s["start"] - 1, F.lit("")))) \
                  .otherwise(none)
        body = F.when(s["end"] > acc["until"],
                      F.array(seg(False, s["start"], s["end"], s["symbol"]))).otherwise(none)
        return F.struct(F.greatest(acc["until"], s["end"]).alias("until"),
                        F.concat(acc["out"], before, body).alias("out")).cast(shape)

    def close(acc: Column) -> Column:
        tail = F.when(acc["until"] + 1 <= n_lines - 1,
                      F.array(seg(True, acc["until"] + 1, n_lines - 1, F.lit("")))) \
                .otherwise(none)
        return F.concat(acc["out"], tail)

    start = F.struct(F.lit(-1).alias("until"), none.alias("out")).cast(shape)
    return F.aggregate(spans, start, step, close)


def chunk_files(files: DataFrame, *keep: str) -> DataFrame:
    """(path, text, *keep) -> chunks; unknown suffixes give no rows."""
    known = files.withColumn("lang", T.path_lang(F.col("path"))).where("lang <> ''")
    spans = known.select(*keep, "path", "lang", F.split("text", "\n", -1).alias("_lines"),
                         syntax_spans(F.col("text"), F.col("lang")).alias("_spans"))
    lines = F.col("_lines")

    def expand(s: Column) -> Column:
        whole = F.array(F.struct((s["first"] + 1).cast("int").alias("start_line"),
                                 (s["last"] + 1).cast("int").alias("end_line"),
                                 s["symbol"].alias("symbol"),
                                 _joined(lines, s["first"], s["last"]).alias("text")))
        return F.when(s["gap"], windows(lines, s["first"], s["last"])).otherwise(whole)

    empty = F.array().cast("array<struct<start:int,end:int,symbol:string>>")
    segments = _segments(F.coalesce(F.col("_spans"), empty), F.size(lines))
    spans = spans.withColumn("_segments", segments)
    chunks = F.flatten(F.transform("_segments", expand))
    return (spans.select(*keep, "path", "lang", F.explode(chunks).alias("_c"))
            .select(*keep, "path", "lang", "_c.start_line", "_c.end_line", "_c.symbol",
                    "_c.text"))
