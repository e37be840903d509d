"""Importance resampling against plain Python."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest import SF, fold

from codeweft.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, score string, weight int"


def grams(text, n):
    w = WORD.findall(fold(text))
    return len(w), [" ".join(w[i:i + k]) for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]


def brute(docs, target, n, buckets, percent, least, seed):
    """{row number: (doc_id, n_features, weight, score, rank)}"""
    crc = lambda g: zlib.crc32(g.encode()) % buckets
    per = [(d, *grams(t, n)) for d, t in docs]
    s, t = Counter(crc(g) for _, _, gs in per for g in gs), Counter(crc(g) for x in target for g in grams(x, n)[1])
    big_s, big_t = s.total(), t.total()
    rows = []
    for d, words, gs in per:
        weight = sum(math.floor(1000 * math.log((t[c] + 1) * (big_s + buckets) / ((s[c] + 1) * (big_t + buckets)))) for c in map(crc, gs))
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, words, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((i for i, r in enumerate(rows) if r[1] >= least), key=lambda i: (-rows[i][4], rows[i][0] is not None, rows[i][0] or 0))
    rank = {i: k + 1 for k, i in enumerate(fit[:percent * len(fit) // 100])}
    return [(*r[:1], *r[2:], rank.get(i)) for i, r in enumerate(rows)]


def test_query_is_brute_force(spark, documents):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in importance.op13(spark, SF).collect())
    want = brute(documents.items(), target, 1, 10_000, 10, 20, 2024)
    assert sorted(want) == got and sum(r[4] is not None for r in got) > 10


@pytest.mark.parametrize("n,buckets", [(1, 7), (2, 50), (4, 1_000)])
def test_longer_features_odd_rows_and_pieces(spark, monkeypatch, n, buckets):
    monkeypatch.setattr(importance, "PIECE_BYTES", 5)       # the driver's own calls; workers keep theirs
    text = "Über-ÜBER 12 ab,cd\x00e  Straße x `a{b|" * 9
    words, found = importance.features_of(text.encode(), n)
    assert (words, found) == (grams(text, n)[0], Counter(zlib.crc32(g.encode()) for g in grams(text, n)[1]))
    docs = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, " ,;\n"), (5, "a b c " * 20), (6, "only three words"),
            (None, "é " * 30), (7, "b a " * 15)]
    target = ["a b c a b", None, "", "Straße a b"]
    frame = spark.createDataFrame([(d, t, "x", 3) for d, t in docs], DOCS)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame, goal, percent=50, min_words=20, n=n, buckets=buckets, seed=9).drop("n_words").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(docs, [t or "" for t in target], n, buckets, 50, 20, 9), key=key)


def test_empty_tables(spark):
    none, goal = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert importance.resample(none, goal).count() == 0
    rows = importance.resample(spark.createDataFrame([(1, "w " * 25, "", 0)], DOCS), goal, percent=100).collect()
    assert rows[0]["rank"] == 1 and rows[0].n_features == 25
