"""Boosted trees against a plain trainer that splits one leaf at a time."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.operators import boosting as B
from codeweft.operators.forest import Forest

RNG = np.random.default_rng(2)
N = 700
X = np.column_stack([RNG.integers(0, 12, N), RNG.normal(size=N).round(1), RNG.integers(0, 3, N), RNG.random(N).round(2)]).astype(float)
Y = ((X[:, 0] > 5) ^ (X[:, 1] > 0.3) ^ (RNG.random(N) < 0.1)).astype(int)
NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, *map(float, x), int(y), bool(i % 4 == 0)) for i, (x, y) in enumerate(zip(X, Y))],
                                 "i int, a double, b double, c double, d double, label int, v boolean").repartition(5).cache()


def plain(x, y, keys, o):
    """Trees as nested dicts, leaf by leaf; node order is settled by gain, then by age."""
    edges = [sorted(set(x[:, i]))[:-1] for i in range(x.shape[1])]
    p = (y.sum() + 0.5) / (len(y) + 1)
    raw, base = np.full(len(y), np.log(p / (1 - p))), np.log(p / (1 - p))
    for t in range(o.rounds):
        use = B.drawn(keys, o.row_share, o.seed, t)
        pr = 1 / (1 + np.exp(-raw))
        g, h = np.rint((pr - y) * B.UNIT), np.rint(pr * (1 - pr) * B.UNIT)
        chosen = B.features_of_tree(x.shape[1], o.feature_share, o.seed, t)

        def gain(rows):
            best = None
            sc = lambda r: (g[r].sum() / B.UNIT) ** 2 / (h[r].sum() / B.UNIT + o.ridge)
            for f in chosen:
                for e in edges[f]:
                    left, right = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                    if min(len(left), len(right)) >= o.min_leaf:
                        v = round(sc(left) + sc(right) - sc(rows), 9)
                        if v > 0 and (best is None or v > best[0]):
                            best = (v, f, e)
            return best

        leaves = [(np.flatnonzero(use), np.arange(len(y)))]
        gains = [gain(leaves[0][0])]
        while len(leaves) < o.leaves and any(gains):
            k = max(range(len(leaves)), key=lambda j: gains[j][0] if gains[j] else -1)
            _, f, e = gains[k]
            seen, every = leaves.pop(k)
            gains.pop(k)
            for side in (lambda r: r[x[r, f] <= e], lambda r: r[x[r, f] > e]):
                leaves.append((side(seen), side(every)))
                gains.append(gain(leaves[-1][0]))
        for seen, every in leaves:
            raw[every] -= o.rate * (g[seen].sum() / B.UNIT) / (h[seen].sum() / B.UNIT + o.ridge)
    return raw


@pytest.mark.parametrize("o", [B.Options(rounds=3, leaves=6, min_leaf=20, refresh=2, row_share=1.0, feature_share=1.0, rate=0.3),
                               B.Options(rounds=4, leaves=9, min_leaf=5, refresh=3, row_share=0.7, feature_share=0.5, rate=0.2, seed=5)])
def test_margins_are_those_of_a_plain_trainer(rows, o):
    keys = {r.i: r.k for r in rows.select("i", F.xxhash64(*NAMES, "label").alias("k")).collect()}
    want = plain(X, Y, np.array([keys[i] for i in range(N)]), o)
    model = B.train(rows, NAMES, o)
    assert len(model["trees"]) == o.rounds and max(len(t["f"]) for t in model["trees"]) <= 2 * o.leaves - 1
    got = {r.i: r.raw for r in Forest.of(model).apply(rows).select("i", "raw").collect()}
    assert np.allclose([got[i] for i in range(N)], want, atol=1e-9)


def test_early_stop_and_learning(rows):
    o = B.Options(rounds=60, leaves=8, min_leaf=10, refresh=4, patience=8, rate=0.3)
    model = B.train(rows, NAMES, o, validation="v")
    assert len(model["trees"]) < 60
    scored = Forest.of(model).apply(rows).where("v")
    assert scored.where((F.col("score") >= 0.5) == (F.col("label") == 1)).count() / scored.count() > 0.8
    assert B.train(rows, NAMES, o, validation="v") == model


def test_odd_tables(spark, rows):
    o = B.Options(rounds=2, leaves=4, min_leaf=5)
    for odd in (rows.limit(0), rows.withColumn("label", F.lit(1)), rows.withColumn("a", F.lit(1.0)).select("a", "label", F.lit(0.0).alias("b"),
                                                                                                     F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))):
        model = B.train(odd, NAMES, o)
        assert len(model["trees"][0]["f"]) == 1 or odd.select("label").distinct().count() == 1
    many = spark.range(3_000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                     F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("c"), F.lit(0.0).alias("d"),
                                     (F.col("id") > 1500).cast("int").alias("label"))
    model = B.train(many, NAMES, o)
    got = Forest.of(model).apply(many.fillna(1e9)).select(F.corr("raw", "label")).first()[0]
    assert got > 0.9
