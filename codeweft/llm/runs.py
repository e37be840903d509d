"""Periodic runs of words: found and collapsed by a descending-LCP Kruskal over the suffixes of each text.

A run is a stretch of words with a smallest period q that no neighbouring word extends. The suffixes
of a text are sorted by prefix doubling; neighbours in that order are edges weighed by their common
prefix (LCP). Edges are taken by descending LCP and unite classes of suffixes with union-find, each
class with its positions in order. When positions i < j become neighbours in a class at LCP l and
j - i <= l, the words from i to j + l repeat with period j - i: a seed. A run of length L has its seed
at its first word: that word and the one q later share exactly L - q words, and while L >= 3q no
position between them can, or the period would be less (Fine and Wilf). Seeds that a word before
them extends are parts of others; of seeds of the same words, met while equal LCPs are being united,
the least period is the run's.

Runs of `least` words and `times` periods need an LCP of least - least // times, so the forest grows
down to that only, and texts in which no such window repeats are done after one look. Rows are mapped
one by one: nothing shuffles, and a hot key does not matter. A text is handled in one task, with about
100 bytes a word and 4 more for each doubling while it has repeats; words are compared by 64-bit hashes."""
from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from .text import fresh, words as words_column
from .words import Words, grams, mix, words_of

SLICE_BYTES = 2 << 20           # texts worked on at once; a longer one is a slice of its own
BLOCK = 512
_WORD = re.compile("[^\\x20\\x09-\\x0D]+")
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Positions:
    """An ordered set of integers in blocks, so that adding one moves few others."""

    def __init__(self, first: int):
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def __iter__(self):
        return (x for block in self.blocks for x in block)

    def around(self, x: int) -> tuple[int | None, int | None]:
        """Greatest member below and least above an x that is no member."""
        k = bisect_left(self.tops, x)
        if k == len(self.tops):
            return self.tops[-1], None
        i = bisect_left(self.blocks[k], x)
        below = self.blocks[k][i - 1] if i else self.tops[k - 1] if k else None
        return below, self.blocks[k][i]

    def add(self, x: int) -> None:
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, x)
        if len(block) > 2 * BLOCK:
            self.blocks[k:k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops[k:k + 1] = [block[BLOCK - 1], block[-1]]
        else:
            self.tops[k] = block[-1]
        self.size += 1


def _refined(rank: np.ndarray, second: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks after a tie of `rank` among `active` is broken by `second`, and those still tied. A rank
    is the place of its class's first member in the suffix order."""
    key = rank[active].astype(np.int64) * (len(rank) + 1) + second
    order = np.argsort(key, kind="stable")
    key, active = key[order], active[order]
    old = rank[active]
    new_class = np.concatenate(([True], old[1:] != old[:-1]))
    new_part = np.concatenate(([True], key[1:] != key[:-1]))
    at = np.arange(len(key))
    class_start = np.maximum.accumulate(np.where(new_class, at, 0))
    part_start = np.maximum.accumulate(np.where(new_part, at, 0))
    out = rank.copy()
    out[active] = old + (part_start - class_start)
    single = new_part & np.concatenate((new_part[1:], [True]))
    return out, active[~single]


def suffix_ranks(words: Words) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... words of every suffix, until no two are alike. Suffixes of one
    text stand together; a suffix that has ended comes before those that go on."""
    n = len(words.hashes)
    text = words.text_of_word()
    end = np.repeat(words.offsets[1:], words.counts)
    order = np.lexsort((words.hashes, text))
    first = np.concatenate(([True], (words.hashes[order][1:] != words.hashes[order][:-1]) | (text[order][1:] != text[order][:-1])))
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    active = order[~(first & np.concatenate((first[1:], [True])))]
    levels, width = [rank], 1
    while len(active):
        after = active + width
        second = np.where(after < end[active], rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        rank, active = _refined(rank, second, active)
        levels.append(rank)
        width *= 2
    return levels


def common_prefixes(words: Words, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix order, and (place, LCP with the place before) where the LCP is `least` or more."""
    n = len(words.hashes)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    coarse = levels[min(max(least.bit_length() - 1, 0), len(levels) - 1)]       # ranks by at most `least` words
    place = np.flatnonzero(coarse[order[1:]] == coarse[order[:-1]]) + 1
    i, j = order[place - 1], order[place]
    room = np.repeat(words.offsets[1:], words.counts)
    room = np.minimum(room[i] - i, room[j] - j)                                 # a class never spans two texts
    lcp = np.zeros(len(place), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(lcp + (1 << k) <= room)
        same = levels[k][i[fits] + lcp[fits]] == levels[k][j[fits] + lcp[fits]]
        lcp[fits[same]] += 1 << k
    good = lcp >= least
    return order, place[good], lcp[good]


def seeds(order: np.ndarray, place: np.ndarray, lcp: np.ndarray, before: list[int], times: int) -> dict[tuple[int, int], int]:
    """{(start, end): period} of all stretches of `times` periods or more that extend neither way.

    `before` tells the word in front of each position; it is different for every first word."""
    by_lcp = np.argsort(-lcp, kind="stable")
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}
    found: dict[tuple[int, int], int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for e, level in zip(place[by_lcp].tolist(), lcp[by_lcp].tolist()):
        a, b = root(e - 1), root(e)
        large = classes.pop(a, None) or Positions(int(order[a]))
        small = classes.pop(b, None) or Positions(int(order[b]))
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        parent[b] = a
        reach = level // (times - 1)            # level + period >= times * period
        last, new = None, list(small)
        for k, x in enumerate(new):
            below, above = large.around(x)
            if below is not None and x - below <= reach and (last is None or below > last) and before[below] != before[x]:
                found[below, x + level] = min(x - below, found.get((below, x + level), x))
            if (above is not None and above - x <= reach and (k + 1 == len(new) or above < new[k + 1])
                    and before[above] != before[x]):
                found[x, above + level] = min(above - x, found.get((x, above + level), above))
            last = x
        for x in new:
            large.add(x)
        classes[a] = large
    return found


def runs_of(words: Words, least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period: at least `least` words
    and `times` (two or more) periods long."""
    shared = max(least - least // times, 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words.counts]
    # texts in which a window of `shared` words is found twice
    start, hashes = grams(words, shared)
    text = words.text_of_word()
    keyed = mix(hashes ^ mix(text[start].astype(np.uint64)))
    by_key = np.argsort(keyed)
    again = by_key[1:][keyed[by_key][1:] == keyed[by_key][:-1]]
    texts = np.unique(text[start[again]])
    if not len(texts):
        return out
    chosen = np.zeros(len(words.counts), bool)
    chosen[texts] = True
    some = Words(words.hashes[chosen[text]], np.concatenate(([0], np.cumsum(words.counts[texts]))))
    levels = suffix_ranks(some)
    order, place, lcp = common_prefixes(some, levels, shared)
    before = np.concatenate(([0], levels[0][:-1].astype(np.int64)))
    before[some.offsets[:-1][some.counts > 0]] = -1 - np.arange(int((some.counts > 0).sum()))
    owner = some.text_of_word()
    for (begin, end), period in sorted(seeds(order, place, lcp, before.tolist(), times).items()):
        if end - begin >= least:
            t = owner[begin]
            out[texts[t]].append((int(begin - some.offsets[t]), end - begin, period))
    for rows in out:
        rows.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(text: str, runs: list[tuple[int, int, int]], n: int) -> str:
    """The words that no run holds after its first period, one space apart."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    kept = np.cumsum(depth[:-1]) == 0
    return " ".join(m[0] for m, keep in zip(_WORD.finditer(text), kept) if keep)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of SLICE_BYTES or a single row."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, "right")))
        yield i, j
        i = j


def collapse_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """`docs` without `text`, plus `n_words`, `runs` (start, length, period of each, in words from 0, by
    start, then period) and `collapsed`: the text's words one space apart, without those that a run
    holds after its first period.

    A null or empty text has no words, no runs and "" as collapsed. One row in, one row out; repeated
    rows give repeated results; an empty table gives no rows. Other columns pass through, but columns
    called n_words, runs or collapsed are replaced."""
    (body,) = fresh(docs.columns, "body")
    made = ("n_words", "runs", "collapsed")
    keep = [c for c in docs.columns if c not in (text, *made)]
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(body))
    schema = given.drop(body).schema.add("n_words", "long").add(
        "runs", ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))).add("collapsed", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pc.fill_null(batch.column(body).cast(pa.large_string()), "")
            for i, j in _slices(pc.binary_length(whole).to_numpy()):
                texts = whole.slice(i, j - i)
                words = words_of(texts)
                found = runs_of(words, least, times)
                plain = pc.utf8_trim(pc.replace_substring_regex(texts, "[ \\t-\\r]+", " "), " ")
                if any(found):
                    plain = pa.array([_collapsed(t.as_py(), r, int(n)) if r else p.as_py()
                                      for t, r, n, p in zip(texts, found, words.counts, plain)], pa.large_string())
                flat = np.array([r for rows in found for r in rows], np.int64).reshape(-1, 3)
                ends = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(RUNS.value_type))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in keep), pa.array(words.counts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), spans), plain.cast(pa.string())], names=[*keep, *made])

    return given.mapInArrow(work, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text of the query: of one document in ten, as a checksum of its id decides, the words from a
    place on are the same few words again and again."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, 1, a), F.slice(tail, 1, n - a)), " ")

    # the words are bound once by a one-element transform
    changed = F.get(F.transform(F.array(words_column(text)), periodic), 0)
    return F.when((h % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), changed).otherwise(text)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = collapse_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), least=24, times=3)

    def order(a, b):                       # exact: lengths over periods, crosswise
        return F.when(a["length"] * b["period"] != b["length"] * a["period"],
                      F.signum(b["length"] * a["period"] - a["length"] * b["period"])).when(
            a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(
            F.signum(a["period"] - b["period"])).cast("int")

    best = F.get(F.array_sort("runs", order), 0)
    shown = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
                      best["length"].alias("length"), best["period"].alias("period"),
                      F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
                      F.sha2(shown, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
