"""Neighbours and duplicates against brute force, on both execution paths."""
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.operators import duplicates as D, knn

RNG = np.random.default_rng(3)
DIM, N = 12, 160
BASE = RNG.normal(size=(N, DIM)).astype(np.float32)
BASE[40:60] = BASE[0:20]                                  # exact copies: ties
REPO = ["hot" if i % 3 else f"r{i % 7}" for i in range(N)]


@pytest.fixture(scope="module")
def chunks(spark):
    unit = BASE / np.linalg.norm(BASE, axis=1, keepdims=True)
    rows = [(i, REPO[i], f"src/f{i % 5}.rs", i, i + 9, f"s{i}", "rust", "x" * 400, [float(x) for x in unit[i]])
            for i in range(N)]
    return spark.createDataFrame(rows, "id long, repo string, path string, start_line int, end_line int, "
                                       "symbol string, lang string, text string, embedding array<float>").cache()


def _unit():
    u = (BASE / np.linalg.norm(BASE, axis=1, keepdims=True)).astype(np.float64)
    return u


def _nearest(i, k):
    d = np.round(((_unit() - _unit()[i]) ** 2).sum(1), 9)
    return [int(j) for j in np.lexsort((np.arange(N), d))[:k]]


def test_top_k_orders_ties_by_id(chunks):
    q = [float(x) for x in _unit()[45]]
    rows = knn.search(chunks, q, 9).collect()
    assert [r["id"] for r in rows][:2] == [5, 45]
    assert rows[0]["cos"] == pytest.approx(1.0, abs=1e-6) and rows[0]["text_len"] == 400
    assert sorted(r["id"] for r in rows) == sorted(_nearest(45, 9))


@pytest.mark.parametrize("path", [{}, {"broadcast_bytes": 0, "cell_bytes": 8 * DIM * 37}])
def test_batch_top_k(chunks, path):
    asked = chunks.select(F.col("id").alias("qid"), "embedding")
    got = {}
    for r in knn.batch_top_k(asked, chunks, 6, **path).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {i: _nearest(i, 6) for i in range(N)}


def _brute_best():
    u = _unit()
    sims = u @ u.T
    out = {}
    for i in range(N):
        other = [j for j in range(N) if REPO[j] != REPO[i]]
        top = max(sims[i, j] for j in other)
        out[i] = (min(j for j in other if sims[i, j] >= top - 1e-9), round(top, 6))
    return out


@pytest.mark.parametrize("path", [{}, {"broadcast_bytes": 0, "cell_bytes": 8 * DIM * 37}])
def test_best_foreign(chunks, path):
    got = {r["id"]: (r["best_id"], r["sim"]) for r in D.best_foreign(chunks, **path).collect()}
    want = _brute_best()
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-5 for i in want)


def test_pairs_agree_on_both_paths(chunks):
    a = D.analysis_set(chunks)
    one = D.in_report_order(D.find_pairs(a, 0.5)).collect()
    two = D.in_report_order(D.find_pairs(a, 0.5, broadcast_bytes=0, cell_bytes=8 * DIM * 37)).collect()
    assert one and one == two
    assert sum(r["n"] for r in one) == sum(s >= 0.5 for _, s in _brute_best().values())


def test_pairs_only_across_repos(spark):
    rows = [(0, "r1", "a", 1, "s", [.6, .8, 0]), (1, "r2", "b", 1, "t", [.61, .79, .02]),
            (2, "r1", "c", 1, "u", [0, 0, 1]), (3, "r1", "d", 1, "v", [0, 0, 1])]
    df = spark.createDataFrame([(*r[:5], [float(x) for x in r[5]]) for r in rows],
                               "id long, repo string, path string, start_line int, symbol string, embedding array<float>")
    got = D.find_pairs(df, 0.93).collect()
    assert [(r["a"], r["b"], r["n"], r["example"]) for r in got] == [("r1/a", "r2/b", 2, "s")]
    assert got[0]["max_sim"] >= 0.99
    assert D.find_pairs(df.where("id > 1"), 0.5).count() == 0
    ledger = spark.createDataFrame(got)
    assert D.new_pairs(ledger, None).count() == 0 and D.new_pairs(ledger, ledger).count() == 0
    assert {(r["file"], r["other"]) for r in D.both_directions(ledger).collect()} == \
        {("r1/a", "r2/b"), ("r2/b", "r1/a")}


def test_filters_before_and_after(chunks):
    q = [float(x) for x in _unit()[8]]
    repo = "r1"
    pre = [r["id"] for r in knn.pre_filtered(chunks, q, repo, 3).collect()]
    want = [j for j in _nearest(8, N) if REPO[j] == repo][:3]
    assert pre == want
    assert [r["id"] for r in knn.post_filtered(chunks, q, repo, 3).collect()] == want
    pool = _nearest(8, 50)
    assert [r["id"] for r in knn.post_filtered(chunks, q, repo, 3, pool=50).collect()] == \
        [j for j in pool if REPO[j] == repo][:3]


@pytest.mark.parametrize("path", [{}, {"broadcast_bytes": 0, "cell_bytes": 8 * DIM * 37}])
def test_nearest_foreign_skips_own_repo(chunks, path):
    """However many of the nearest are the query's own."""
    asked = chunks.select(F.col("id").alias("qid"), F.col("repo").alias("own_repo"), "embedding")
    got = {r["qid"]: r["id"] for r in knn.nearest_foreign(asked, chunks, **path).collect()}
    for i in range(N):
        assert got.get(i) == next((j for j in _nearest(i, N) if REPO[j] != REPO[i]), None)


def test_merge_is_limited_before_its_shuffles(chunks):
    found = chunks.select(F.lit(1).alias("qid"), "id", F.col("start_line").cast("double").alias("distance"))
    best = knn.best_k(found.repartition(9), 4, 9)
    assert [(r["id"], r["rank"]) for r in best.orderBy("rank").collect()] == [(i, i) for i in range(4)]
    plan = best._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("pushed", [1000, 3])
def test_bounded_search_is_exact(spark, chunks, monkeypatch, pushed):
    monkeypatch.setattr(knn, "MAX_PUSHED", pushed)
    codes = knn.quantised(chunks).cache()
    rng = np.random.default_rng(1)
    for q in [_unit()[45], rng.normal(size=DIM), np.zeros(DIM)]:
        q = [float(x) for x in q]
        want = [tuple(r) for r in knn.top_k(chunks, q, 9).collect()]
        assert [tuple(r) for r in knn.bounded_top_k(chunks, codes, q, 9).collect()] == want
    assert knn.bounded_top_k(chunks.where("false"), codes.where("false"), q, 9).count() == 0
    row = codes.where("id = 3").first()
    v = np.frombuffer(row["codes"], np.int8) * row["scale"]
    assert np.linalg.norm(v - _unit()[3]) <= row["error"] + 1e-7


def test_bounded_search_reads_candidates_only(spark, chunks, tmp_path):
    chunks.write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    found = knn.bounded_top_k(stored, knn.quantised(stored).cache(), [float(x) for x in _unit()[8]], 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id" in plan


def test_clustered_vectors_skip_pairs_of_blocks(spark):
    """Thirty far clusters, one of them with a third of all rows: fewer pairs than all, same answer."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, DIM))
    which = np.where(rng.random(900) < 0.33, 0, rng.integers(0, 30, 900))
    rows = centres[which] + 0.01 * rng.normal(size=(900, DIM))
    df = spark.createDataFrame([(i, f"r{i % 5}", [float(x) for x in v]) for i, v in enumerate(rows)],
                               "id long, repo string, embedding array<float>")
    v = D._keyed(df)
    n, row_bytes = D._row_bytes(v)
    pruned = D.Pruned(v, v, n, row_bytes, -1.0, "id bigint, best_id bigint, sim double", row_bytes * 40)
    got = sorted(map(tuple, pruned.answer().collect()))
    assert got == sorted(map(tuple, D.best_foreign(df).collect())) and len(got) == 900
    assert pruned.pairs_met < pruned.all_pairs() / 3
    assert pruned.parts.max() > 5                          # the large cluster is several blocks


@pytest.mark.parametrize("path", [{}, {"broadcast_bytes": 0, "cell_bytes": 8 * DIM * 37}])
@pytest.mark.parametrize("threshold", [-1.0, 0.4])
def test_best_matches_after_a_change(spark, chunks, path, threshold):
    """Removed, changed and added chunks, copies among them: as from scratch."""
    old = chunks.where("id < 130")
    removed = chunks.where("id % 7 = 0 AND id < 130 OR id = 45")
    changed = chunks.where("id = 45").withColumn("embedding", F.reverse("embedding"))
    added = chunks.where("id >= 130").unionByName(changed)
    now = old.join(removed.select("id"), "id", "left_anti").select(*chunks.columns).unionByName(added)
    best = D.best_foreign(old, threshold)
    got = D.refreshed_best(best, old, removed, added, threshold, **path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.best_foreign(now, threshold).collect()))


def test_rendered_answer(chunks):
    got = knn.semantic_search(chunks, [float(x) for x in _unit()[8]], 2)
    assert len(got) == 2 and abs(got[0]["distance"]) < 1e-6
    assert knn.semantic_search(chunks.where("false"), [0.0] * DIM) == []


def test_ledger_round_trip(spark, tmp_path):
    from codeweft.sources import files
    rows = [(f"r/{i}", f"s/{i}", i, 0.95, "x") for i in range(10)]
    from codeweft import schemas
    ledger = spark.createDataFrame(rows, schemas.LEDGER)
    D.in_report_order(ledger).coalesce(1).write.json(str(tmp_path / "ledger"))
    back = files.read_ledger(spark, str(tmp_path / "ledger"))
    assert sorted(map(tuple, back.collect())) == rows
    assert D.new_pairs(ledger, back).count() == 0
    assert files.read_ledger(spark, str(tmp_path / "nothing")) is None


def test_nearest_memory_is_that_of_its_queries():
    rng = np.random.default_rng(8)
    q, v = rng.normal(size=(3000, 16)), np.round(rng.normal(size=(60_000, 16)), 1)
    v[30_000:] = v[:30_000]                               # ties that pass in other batches
    ids = rng.permutation(60_000)
    tracemalloc.start()
    best = knn.Nearest(np.arange(3000), q, None, 30)
    for s in range(0, 60_000, 6000):
        best.add(ids[s:s + 6000], v[s:s + 6000], None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    for i in range(0, 3000, 97):
        d2 = np.round(np.maximum((q[i] ** 2).sum() + (v ** 2).sum(1) - 2 * v @ q[i], 0), 12)
        assert np.allclose(best.d2[i], np.sort(d2)[:30], atol=2e-12)
        assert best.found[i].tolist() == ids[np.lexsort((ids, np.round(d2, 9)))[:30]].tolist()


def test_duplicates_hold_small_tiles():
    rng = np.random.default_rng(9)
    a, b = (D.normalised(rng.normal(size=(n, 16))) for n in (4000, 30_000))
    repo = np.arange(30_000) % 5
    tracemalloc.start()
    _, best, sim = D._best(np.arange(4000), repo[:4000], a, np.arange(30_000), repo, b, -1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and D.CELL_BYTES <= 16 << 20
    for i in range(0, 4000, 401):
        s = np.where(repo == repo[i], -2, np.round(b @ a[i], 9))
        assert best[i] == s.argmax() and abs(sim[i] - s.max()) < 1e-8
