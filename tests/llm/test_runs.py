"""Periodic runs against a brute-force version."""
import hashlib
import random
import zlib
from math import floor

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, words

from codeweft.llm import runs
from codeweft.llm.words import words_of

DOCS = "doc_id long, text string, runs string, __body int"


def brute(w, least, times):
    """Maximal stretches of every period; the least period of a stretch is its own."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, times * q))


def collapse(w, found):
    drop = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in drop)


@pytest.mark.parametrize("least,times", [(24, 3), (2, 2), (6, 2), (5, 4), (1, 3)])
def test_runs_of_random_texts(least, times):
    rng = random.Random(least * 10 + times)
    texts = ["", " ", "a", "a " * 200, "ab cd " * 41 + "ab"]
    for _ in range(150):
        base = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
        piece = [rng.choice("ab") for _ in range(rng.randint(1, 14))]
        texts.append(" ".join(base + piece * rng.randint(0, 6) + piece[:rng.randint(0, 9)] + base[:rng.randint(0, 30)]))
    a, b = ["a"], ["a", "b"]
    for _ in range(9):
        a, b = b, b + a                     # Fibonacci words have many overlapping runs
    texts.append(" ".join(b))
    got = runs.runs_of(words_of(pa.array(texts)), least, times)
    assert got == [brute(words(t), least, times) for t in texts]


def test_positions_keep_order():
    rng = random.Random(5)
    values = rng.sample(range(10_000), 5_000)
    kept = runs.Positions(values[0])
    for k, x in enumerate(values[1:], 1):
        if k % 97 == 0:
            below, above = [v for v in values[:k] if v < x], [v for v in values[:k] if v > x]
            assert kept.around(x) == (max(below, default=None), min(above, default=None))
        kept.add(x)
    assert list(kept) == sorted(values) and kept.size == len(values)


def test_long_text_with_one_period_and_slices(monkeypatch):
    monkeypatch.setattr("codeweft.llm.words.SLICE_BYTES", 64)
    text = "x y " + "one two three " * 3_000 + "z"
    assert runs.runs_of(words_of(pa.array([text, None, text])))[2] == [(2, 9_000, 3)]
    assert runs.runs_of(words_of(pa.array(["go " * 20_000])))[0] == [(0, 20_000, 1)]


def test_odd_rows(spark):
    loop = "a b c " * 10
    rows = [(1, loop, "x", 1), (1, loop, "x", 1), (None, loop, None, None), (2, None, "y", 2), (3, "", None, None),
            (4, " \t\n", None, None), (5, "plain  words\tonly ", None, 3)]
    out = runs.collapse_runs(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "__body", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    one = (30, [(0, 30, 3)], "a b c")
    assert got == sorted([(1, *one), (1, *one), (None, *one), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""),
                          (5, 3, [], "plain words only")], key=str)
    assert runs.collapse_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_query_is_brute_force(spark, documents):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    got = {r.doc_id: tuple(r)[1:] for r in runs.op11(spark, SF).collect()}
    assert len(got) == len(documents)
    planted = 0
    for d, text in documents.items():
        w, h = words(text), zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        # periods that occur at all: those of equal 16-word windows (brute() would take minutes)
        ids = np.unique(w, return_inverse=True)[1] if w else np.zeros(0, int)
        found = {}
        for q in range(1, n // 3 + 1):
            same = np.concatenate(([False], ids[q:] == ids[:-q], [False]))
            edge = np.flatnonzero(same[1:] != same[:-1])
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if e - s + q >= max(24, 3 * q):
                    found.setdefault((s, e + q), q)
        found = sorted((s, e - s, q) for (s, e), q in found.items())
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        exponent = floor(1000 * best[1] / best[2]) if best else None
        assert got[d] == (len(found), *(best or (None,) * 3), exponent, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
                          sha(collapse(w, found)))
    assert planted > 10
