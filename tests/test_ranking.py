"""Features, forests, metrics and order statistics against brute force."""
import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.constants import FEATURES
from codeweft.functions import text as T
from codeweft.operators import features as G, forest, history, metrics as M, ordering


def _hits(spark, rows, query="parse headers", repo="org/r"):
    df = spark.createDataFrame([(1, query, repo, i, *r) for i, r in enumerate(rows)],
                               "qid int, query string, query_repo string, id int, repo string, path string, cos double, "
                               "symbol string, lang string, text_len int")
    df = df.withColumn("distance", F.sqrt(2.0 - 2.0 * F.col("cos"))).drop("cos") \
           .withColumn("query_tokens", T.tokens(F.col("query")))
    return [r.asDict() for r in G.group_features(df).orderBy("rank").collect()]


def test_relative_columns(spark):
    got = _hits(spark, [("org/r", "src/a.rs", .9, "parse_headers", "rust", 500),
                        ("org/r", "src/b.rs", .7, "", "markdown", 500),
                        ("org/other", "src/tests/c.rs", .5, None, "rust", 10)])
    col = lambda n: [r[n] for r in got]
    assert set(FEATURES) <= set(got[0])
    assert col("rank") == [0, 1, 2] and col("cos_gap_top")[0] == 0 and col("same_repo") == [1, 1, 0]
    assert col("has_symbol") == [1, 0, 0] and col("is_code_lang") == [1, 0, 1] and col("is_excluded_path") == [0, 0, 1]
    assert col("symbol_overlap") == [1.0, 0, 0] and col("path_depth") == [2, 2, 3]
    assert col("cos_z")[0] == pytest.approx(.2 / np.std([.9, .7, .5])) and col("log_text_len")[2] == math.log1p(10)


def test_file_share_and_constant_scores(spark):
    got = _hits(spark, [("o/r", p, .5, "s", "rust", 1) for p in ("a", "a", "b", "c")], repo="")
    assert [r["same_file_frac"] for r in got] == [.5, .5, .25, .25]
    assert {r["cos_z"] for r in got} == {0.0} and {r["same_repo"] for r in got} == {0.0}


def test_labels_and_groups(spark):
    hits = spark.createDataFrame(
        [("o/r@1", 1, "o/r", "src/a.rs", 1, 9, "f", "rust", 300, .4), ("o/r@1", 2, "o/r", "src/b.rs", 1, 9, None, "rust", 300, .5),
         ("o/r@1", 3, "o/x", "src/a.rs", 1, 9, "h", "rust", 300, .6)],
        "qid string, id int, repo string, path string, start_line int, end_line int, symbol string, lang string, text_len int, distance double")
    queries = spark.createDataFrame([("o/r", "1", 5, "a query text", ["src/a.rs"])],
                                    "repo string, sha string, ts long, query string, files array<string>")
    got = G.label(hits, history.touched_files(queries))
    assert [r["label"] for r in got.orderBy("id").collect()] == [1, 0, 0]
    group = history.build_groups(queries, got).first()
    assert group["n_pos"] == 1 and [c["symbol"] for c in group["candidates"]] == ["f", "", "h"]
    back = history.explode_groups(history.build_groups(queries, got)).orderBy("id").collect()
    assert [r["label"] for r in back] == [1, 0, 0] and back[0]["query_repo"] == "o/r"


NESTED = {"objective": "binary sigmoid:1", "tree_info": [{"tree_structure": {
    "split_feature": 1, "threshold": .5, "decision_type": "<=",
    "left_child": {"leaf_value": -1.0},
    "right_child": {"split_feature": 0, "threshold": 2.0, "left_child": {"leaf_value": .5}, "right_child": {"leaf_value": 3.0}}}},
    {"tree_structure": {"leaf_value": .25}}]}


def test_forest_conversion_and_scores(spark, tmp_path):
    import json
    model = forest.from_boosting_dump(NESTED, ["a", "b"], .5)
    assert model["trees"][0] == {"f": [1, -1, 0, -1, -1], "t": [.5, 0, 2.0, 0, 0], "l": [1, -1, 3, -1, -1],
                                 "r": [2, -1, 4, -1, -1], "v": [0, -1.0, 0, .5, 3.0]}
    (tmp_path / "m.json").write_text(json.dumps(model))
    rows = spark.createDataFrame([(1.0, .5), (2.0, .6), (2.1, .6)], "a double, b double")
    got = forest.Forest.load(str(tmp_path / "m.json")).apply(rows).collect()
    assert [r["raw"] for r in got] == [-.75, .75, 3.25] and [r["inject"] for r in got] == [False, True, True]
    assert got[1]["score"] == pytest.approx(1 / (1 + math.exp(-.75)))
    with pytest.raises(ValueError):
        forest.Forest.of({"format": "other"})
    with pytest.raises(ValueError):
        forest.from_boosting_dump({**NESTED, "objective": "regression"}, [], 0)
    with pytest.raises(ValueError):
        forest.kept_features(["nope"])


def test_training_exports_the_same_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + .7 * x[:, 1] + .4 * rng.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, label int")
    model = forest.train(rows, ["a", "b", "c"], rounds=4, step=.3, depth=3, min_leaf=10)
    flat = forest.Forest.of(forest.from_gbt(model, ["a", "b", "c"], .5))
    from pyspark.ml.feature import VectorAssembler
    theirs = model.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="_x").transform(rows)).select("probability").collect()
    mine = 1 / (1 + np.exp(-flat.margins(x)))
    assert max(abs(m - t["probability"][1]) for m, t in zip(mine, theirs)) < 1e-9
    assert forest.importances(model, ["a", "b", "c"])[0][0] == "a"


def _scored(spark, seed, n=300, step=None):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.random() if step is None else round(rng.random() / step) * step
        out.append((i // 10, i % 10, float(s), int(rng.random() < .2 + .5 * s)))
    return out, spark.createDataFrame(out, "qid int, rank int, score double, label int")


def _prf(rows, flag):
    tp = sum(r[3] and flag(r) for r in rows)
    sel = sum(flag(r) for r in rows)
    pos = sum(r[3] for r in rows)
    p, q = (tp / sel if sel else 0), (tp / pos if pos else 0)
    return p, q, (2 * p * q / (p + q) if p + q else 0), sel


@pytest.mark.parametrize("seed,step", [(1, None), (2, .05), (3, .3)])
def test_metrics_agree_with_brute_force(spark, seed, step):
    rows, df = _scored(spark, seed, step=step)
    p, r, f, sel = _prf(rows, lambda x: x[2] >= .4)
    got = M.prf(df, F.col("score") >= .4).first()
    assert (got["precision"], got["recall"], got["f1"], got["selected"]) == (round(p, 4), round(r, 4), round(f, 4), sel)

    cuts = sorted({round(x[2], 4) for x in rows})
    f1s = [round(_prf(rows, lambda x: x[2] >= c)[2], 4) for c in cuts]
    best = M.best_threshold(df).first()
    assert best["f1"] == max(f1s) and best["threshold"] == cuts[f1s.index(max(f1s))]

    pos, area = sum(x[3] for x in rows), 0.0
    for s in sorted({x[2] for x in rows}, reverse=True):
        above = [x for x in rows if x[2] >= s]
        area += sum(x[3] for x in rows if x[2] == s) / pos * sum(x[3] for x in above) / len(above)
    assert M.average_precision(df).first()[0] == pytest.approx(area, abs=6e-5)

    lists = {}
    for x in rows:
        lists.setdefault(x[0], []).append(x)
    for k in (5, 10):
        prec = np.mean([np.mean([x[3] for x in sorted(v, key=lambda x: (-x[2], x[1]))[:k]]) for v in lists.values()])
        ndcg = []
        for v in lists.values():
            disc = [1 / math.log2(i + 2) if i < k else 0 for i in range(len(v))]
            order = sorted(v, key=lambda x: -x[2])
            mean = {s: np.mean([x[3] for x in v if x[2] == s]) for s in {x[2] for x in v}}
            ideal = sum(d for d, _ in zip(disc, range(sum(x[3] for x in v))))
            ndcg.append(sum(mean[x[2]] * d for x, d in zip(order, disc)) / ideal if ideal else 0)
        assert M.precision_at_k(df).first()[f"p_at_{k}"] == pytest.approx(prec, abs=6e-5)
        assert M.ndcg_at_k(df).first()[f"ndcg_at_{k}"] == pytest.approx(np.mean(ndcg), abs=6e-5)


def test_metrics_of_nothing(spark):
    _, df = _scored(spark, 1)
    none = df.where("false")
    assert tuple(M.best_threshold(none).first()) == (0.5, -1.0)
    assert tuple(M.prf(none, F.col("score") > 0).first()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        M.time_split(df.select(F.col("qid").alias("ts"), F.col("rank").alias("sha")).limit(10))


def test_evaluate(spark):
    _, df = _scored(spark, 5)
    got = M.evaluate(df.where("qid < 20"), df.where("qid >= 20"))
    assert set(got) == {"threshold", "precision", "recall", "f1", "selected", "pr_auc", "ndcg_at_5", "ndcg_at_10",
                        "p_at_5", "p_at_10"}


def test_ranks_with_a_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < .6 else f"g{rng.randint(0, 5)}", rng.randint(0, 50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = {r["i"]: r["rank"] for r in ordering.rank_in_group(df, ["g"], ["v", "i"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[r[2]] = n
    assert got == want


def test_running_totals(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0.5, rng.random()]), 1) for _ in range(700)]
    df = spark.createDataFrame(rows, "s double, n int")
    for r in ordering.running_totals(df, "s", ["n"]).collect():
        assert r["cum_n"] == sum(x[0] >= r["s"] for x in rows)


def test_train_command(spark, tmp_path, capsys):
    import json

    from codeweft import __main__ as cli
    rng = random.Random(3)
    with open(tmp_path / "groups.json", "w") as fh:
        for g in range(60):
            cands = []
            for i in range(5):
                hit = int(rng.random() < .4)
                cands.append({"repo": "o/a" if hit or rng.random() < .3 else "o/b", "path": f"src/f{i}.rs", "start_line": 1,
                              "end_line": 9, "symbol": f"s{i}", "lang": "rust", "text_len": 300 + i,
                              "distance": .4 + .1 * i + .2 * rng.random(), "label": hit})
            fh.write(json.dumps({"repo": "o/a", "sha": f"{g:03d}", "ts": 1_700_000_000 + g * 86400, "query": f"make f{g % 5} faster",
                                 "n_pos": sum(c["label"] for c in cands), "candidates": cands}) + "\n")
    args = cli.parser().parse_args(["train", "--data", str(tmp_path / "groups.json"), "--out-model", str(tmp_path / "m.json"),
                                    "--rounds", "3", "--keep-negative-groups", "--drop-features", "rank"])
    assert args.run(spark, args) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["test"]["queries"] == 12 and report["train"]["queries"] == 48 and "rank" not in report["features"]
    newest = datetime.datetime.fromtimestamp(1_700_000_000 + 59 * 86400, datetime.UTC).date().isoformat()
    assert report["test"]["last_commit"] == newest and 0 <= report["model"]["f1"] <= 1
    model = forest.Forest.load(str(tmp_path / "m.json"))
    assert model.threshold == report["model"]["threshold"] and model.features == report["features"]
