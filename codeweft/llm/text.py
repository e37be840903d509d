"""Column expressions on whole texts that several operators share. A word is a maximal run of
characters other than space and U+0009 to U+000D; a null text has no words."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACES = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def without(text: Column, chars: str) -> Column:
    """`text` without the given characters. One byte search per character: far cheaper than translate."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_of(text: Column, chars: str) -> Column:
    """How many characters of `text` are in `chars`."""
    return F.length(text) - F.length(without(text, chars))


def has_word(text: Column) -> Column:
    return text.rlike("[^\\x20\\x09-\\x0D]")


def gram_hashes(words_col: Column, k: int) -> Column:
    """xxhash64 of each k-word window, in order; empty where there are fewer than k words."""
    n = F.size(words_col)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k),
                                      lambda i: F.xxhash64(*[F.get(words_col, i + j) for j in range(k)]))
                  ).otherwise(F.array().cast("array<bigint>"))


def bound(value: Column, use) -> Column:
    """`use(value)` with the value worked out once, as the argument of a one-element transform."""
    return F.get(F.transform(F.array(value), use), 0)


def running_starts(lengths: Column, block: int = 512) -> Column:
    """For each of some non-negative ints the sum of those before it. Sums run inside blocks and then
    over blocks, as an array that grows element by element is copied each time."""
    def sums(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda s, x: F.struct(
            (s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def joined(parts: Column) -> Column:
        before = sums(F.transform(parts, lambda p: p["at"]))["out"]
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p["out"], lambda x: x + b)))

    def split(values: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / block).cast("int"), F.lit(0)))
        return bound(F.transform(blocks, lambda b: sums(F.slice(values, b * block + 1, block))), joined)

    return bound(lengths, split)


def fresh(taken, *names: str) -> list[str]:
    """Column names built from `names` that no column of `taken` has (in any case)."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
