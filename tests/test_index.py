"""Index store, incremental refresh, merge, caches, streaming and the command line."""
import json
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from codeweft import __main__ as cli, schemas
from codeweft.constants import MODEL_NAME
from codeweft.operators import upkeep as U
from codeweft.session import ensure_checkpoint_dir
from codeweft.sources.store import CallGraphStore, IndexStore


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def toy_model():
    """Letter counts as a vector: enough to tell texts apart."""
    def run(texts):
        rows = np.array([[t.count(c) + 1e-3 for c in "abcdefgh"] for t in texts], dtype=np.float32)
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return run


def _snapshot(spark, rows):
    df = spark.createDataFrame([(r, p, t.encode()) for r, p, t in rows], "repo string, path string, content binary")
    return df.withColumn("sha", F.sha2("content", 256))


def _heads(spark, **heads):
    return spark.createDataFrame([(r.replace("_", "/"), h) for r, h in heads.items()], "repo string, head string")


TEXT = "aaa bb\nccc dd\nee ff\ngg hh\n"


def _state(store):
    return {(r["repo"], r["path"]): r["text"].split("\n")[0] for r in store.chunks().collect()}


def test_refresh_life_cycle(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    assert store.model_matches() and store.get_repo_commit("o/a") is None
    files = [("o/a", "x.md", TEXT), ("o/a", "y.md", "b" + TEXT), ("o/b", "z.md", TEXT), ("o/b", "skip.bin", TEXT)]
    got = store.refresh(_snapshot(spark, files), _heads(spark, o_a="1", o_b="1"), toy_model, now="t1")
    assert got == {"repos_updated": 2, "chunks_added": 3, "total": 3}
    assert store.get_repo_commit("o/a") == "1" and store.get_meta("model") == MODEL_NAME

    same = store.refresh(_snapshot(spark, files), _heads(spark, o_a="1", o_b="1"), toy_model, now="t2")
    assert same["repos_updated"] == 0 and same["total"] == 3 and store.get_meta("updated_at") == "t2"

    # x changed, y deleted, w added; b untouched
    files = [("o/a", "x.md", "h" + TEXT), ("o/a", "w.md", TEXT), ("o/b", "z.md", TEXT)]
    got = store.refresh(_snapshot(spark, files), _heads(spark, o_a="2", o_b="1"), toy_model)
    assert got == {"repos_updated": 1, "chunks_added": 2, "total": 3}
    assert _state(store) == {("o/a", "x.md"): "haaa bb", ("o/a", "w.md"): "aaa bb", ("o/b", "z.md"): "aaa bb"}
    assert store.chunks().where("size(embedding) <> 8").count() == 0

    # b is no longer listed; a loses its last file
    store.refresh(_snapshot(spark, files[:0] or [("o/a", "n.bin", "x")]), _heads(spark, o_a="3"), toy_model)
    assert _state(store) == {} and {r["repo"] for r in store.repos().collect()} == {"o/a"}


def test_other_model_rebuilds(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"), model="old")
    store.refresh(_snapshot(spark, [("o/a", "x.md", TEXT)]), _heads(spark, o_a="1"), toy_model)
    fresh = IndexStore(spark, str(tmp_path / "ix"))
    assert not fresh.model_matches()
    assert fresh.refresh(_snapshot(spark, [("o/a", "x.md", TEXT)]), _heads(spark, o_a="1"), toy_model)["chunks_added"] == 1
    assert fresh.model_matches()


def _chunk_rows(spark, rows):
    return spark.createDataFrame([(f"{r}{p}{n}", r, p, n, n + 2, "s", "rust", t, [float(n)] * 4)
                                  for r, p, n, t in rows], schemas.CHUNKS)


def test_deletes(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    store.put_chunks(_chunk_rows(spark, [("r1", "a.rs", 1, "t"), ("r1", "b.rs", 1, "t"), ("r2", "c.rs", 1, "t")]))
    assert store.delete_path("r1", "a.rs") == 1 and store.chunks().count() == 2
    store.delete_repos(["r1"])
    assert [r["repo"] for r in store.chunks().collect()] == ["r2"]
    assert store.delete_path("r2", "c.rs") == 1 and store.chunks().count() == 0


def test_refresh_after_delete_path_and_merge(spark, tmp_path):
    """A dropped file returns; a file that only chunks know, as after a merge, is dropped when it is gone."""
    store = IndexStore(spark, str(tmp_path / "ix"))
    both = _snapshot(spark, [("o/a", "x.md", TEXT), ("o/a", "y.md", TEXT + "more")])
    store.refresh(both, _heads(spark, o_a="1"), toy_model)
    assert store.delete_path("o/a", "x.md") >= 1
    store.refresh(both, _heads(spark, o_a="2"), toy_model)
    assert {r.path for r in store.chunks().collect()} == {"x.md", "y.md"}
    merged = IndexStore(spark, str(tmp_path / "merged"))
    merged.set_meta("model", merged.model)
    merged.put_chunks(store.chunks())
    merged.refresh(_snapshot(spark, [("o/a", "x.md", TEXT)]), _heads(spark, o_a="3"), toy_model)
    assert {r.path for r in merged.chunks().collect()} == {"x.md"}


def _part(spark, rows, repos, model=MODEL_NAME):
    return {"chunks": _chunk_rows(spark, rows),
            "repos": spark.createDataFrame([(r, s, "t") for r, s in repos], schemas.REPOS),
            "meta": spark.createDataFrame([("model", model)], schemas.META)}


def test_merge(spark):
    one = _part(spark, [("r1", "a.rs", 1, "t"), ("r2", "b.rs", 2, "t")], [("r1", "aaa"), ("r2", "bbb")])
    two = _part(spark, [("r1", "c.rs", 3, "t")], [("r1", "aaa"), ("r2", "bbb")])
    merged = U.merge_parts([one, two])
    assert merged["chunks"].count() == 3 and merged["repos"].count() == 2
    with pytest.raises(ValueError, match="pinned"):
        U.merge_parts([one, _part(spark, [("r1", "c.rs", 3, "t")], [("r1", "zzz")])])
    with pytest.raises(ValueError, match="model"):
        U.merge_parts([one, _part(spark, [], [], "other")])


def test_caches(spark):
    rows = _chunk_rows(spark, [("r1", "a.rs", 1, "fn f"), ("r1", "a.rs", 5, "fn g")])
    cache = U.vector_cache(rows)
    asked = _chunk_rows(spark, [("r1", "a.rs", 5, "fn g"), ("r1", "a.rs", 9, "new")])
    got = {r["start_line"]: r["embedding"] for r in U.split_by_cache(asked, cache).collect()}
    assert got == {5: [5.0] * 4, 9: None}
    repos = spark.createDataFrame([("r1", "abc"), ("r9", "zzz")], "repo string, commit_sha string")
    flat = U.chunk_cache(repos, rows)
    assert flat.count() == 3 and flat.where("repo = 'r9' AND path IS NULL").count() == 1
    assert U.reusable(flat, spark.createDataFrame([("r1", "abc"), ("r9", "x")], "repo string, commit_sha string")).count() == 2
    assert U.reusable(flat, spark.createDataFrame([("r1", "moved")], "repo string, commit_sha string")).count() == 0


def test_stored_cache_is_not_shuffled(spark, tmp_path):
    """Only the chunks' side has an exchange, when the cache is written and when another session opens it."""
    rows = _chunk_rows(spark, [("r1", f"{i}.rs", 1, f"fn f{i}") for i in range(50)])
    asked = _chunk_rows(spark, [("r1", f"{i}.rs", 1, f"fn f{i}") for i in range(40, 60)])
    stored = U.store_cache(U.vector_cache(rows), str(tmp_path / "cache"), 8)
    for cache in (stored, U.open_cache(spark, str(tmp_path / "cache"), 8)):
        split = U.split_by_cache(asked, cache, stored=True)
        assert split.where("embedding IS NOT NULL").count() == 10 and split.count() == 20
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert U.store_cache(U.vector_cache(asked), str(tmp_path / "cache"), 8).count() == 20


def test_shards_partition_every_repo(spark):
    rows = _chunk_rows(spark, [(f"r{i % 3}", f"f{i % 7}.rs", i, "t") for i in range(40)])
    seen = [r["id"] for s in range(4) for r in U.stride_shard(rows, s, 4).collect()]
    assert len(seen) == len(set(seen)) == 40
    with pytest.raises(ValueError):
        U.stride_shard(rows, 4, 4)


def test_stream_of_snapshots(spark, tmp_path):
    """Two heads in one batch, in either order, and one that comes late."""
    from codeweft.streaming.ingest import SNAPSHOT, follow_snapshots
    store, landing = IndexStore(spark, str(tmp_path / "ix")), str(tmp_path / "in")
    batches = [[("o/a", "1", "x.md", TEXT, 1)],
               [("o/a", "9", "x.md", "b" + TEXT, 2), ("o/a", "2", "x.md", "c" + TEXT, 3), ("o/a", "9", "old.md", TEXT, 2),
                ("o/b", "7", "y.md", TEXT, None)],
               [("o/a", "5", "x.md", "d" + TEXT, 2), ("o/b", "8", "y.md", "e" + TEXT, 1)]]
    for rows in batches:
        spark.createDataFrame([(r, h, p, t.encode(), q) for r, h, p, t, q in rows], SNAPSHOT).write.mode("append").parquet(landing)
        follow_snapshots(spark, landing, store, toy_model, str(tmp_path / "ck")).awaitTermination(120)
    assert _state(store) == {("o/a", "x.md"): "caaa bb", ("o/b", "y.md"): "eaaa bb"}
    assert store.get_repo_commit("o/a") == "2" and store.get_repo_commit("o/b") == "8"


def test_copy_on_write_touches_few_files(spark, tmp_path):
    from codeweft.sources.versioned import VersionedTable
    table = VersionedTable(spark, str(tmp_path / "t"), "repo string, path string, n int")
    assert table.read().count() == 0 and table.files() == []
    rows = lambda *xs: spark.createDataFrame(list(xs), "repo string, path string, n int")
    nothing = rows().select("repo", "path")
    for repo in ("a", "b", "c"):
        table.change(nothing, rows((repo, "p", 1), (repo, "q", 2)))
    before = set(table.files())
    gone = rows(("b", "p", 0), ("b", "new", 0), ("zz", "p", 0))
    assert len(table.files_with(gone)) == 1
    table.change(gone, rows(("b", "p", 7)))
    after = set(table.files())
    assert len(before - after) == 1 and len(before & after) == len(before) - 1
    assert sorted(tuple(r) for r in table.read().collect()) == [
        ("a", "p", 1), ("a", "q", 2), ("b", "p", 7), ("b", "q", 2), ("c", "p", 1), ("c", "q", 2)]
    assert table.read(table.versions()[-2]).where("n = 7").count() == 0
    table.change(rows(("a", "", 0), ("c", "", 0)), on=["repo"])
    assert {r.repo for r in table.read().collect()} == {"b"}
    table.compact()
    assert table.read().count() == 2 and len(table.files()) <= 3
    table.vacuum(1)
    assert table.read().count() == 2 and len(table.versions()) == 1
    with pytest.raises(Exception, match="(?i)exist"):
        spark.createDataFrame([("x",)], "file string").write.parquet(f"{table.root}/log/{table.versions()[-1]:012d}")


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "calls")
    index = {"metadata": {"tool_info": {"name": "tool"}}, "documents": [{
        "relative_path": "a.rs", "symbols": [], "occurrences": [
            {"range": [1, 3, 5], "symbol": "t c d 1 m/f().", "symbol_roles": 1, "enclosing_range": [1, 0, 4, 1]},
            {"range": [8, 3, 5], "symbol": "t c d 1 m/g().", "symbol_roles": 1, "enclosing_range": [8, 0, 9, 1]},
            {"range": [2, 4, 5], "symbol": "t c d 1 m/g()."}]}]}
    (tmp_path / "i.json").write_text(json.dumps(index))
    run = lambda *a: (lambda p: p.run(spark, p))(cli.parser().parse_args(a))
    for _ in range(2):                                    # loading twice changes nothing
        assert run("scip", "--root", root, "--repo", "o/a", "--json", str(tmp_path / "i.json"), "--commit", "c0ffee") == 0
    assert CallGraphStore(spark, root).tables()["refs"].count() == 1
    capsys.readouterr()
    assert run("calls", "--root", root, "--symbol", "g") == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert rows[0]["truncated"] is False
    callers = [r for r in rows[1:] if r["part"] == "caller"]
    assert [(c["path"], c["line"], c["name"], c["target_name"]) for c in callers] == [("a.rs", 3, "f", "g")]
    assert [r["commit_sha"] for r in rows[1:] if r["part"] == "repo"] == ["c0ffee"]
    assert run("calls", "--root", root, "--symbol", "nothing") == 1
    assert run("calls", "--root", root) == 2
    assert run("calls", "--root", root, "--path", "a.rs", "--lines", "x") == 2

    store = IndexStore(spark, str(tmp_path / "ix"))
    store.refresh(_snapshot(spark, [("o/a", "x.md", TEXT), ("o/b", "y.md", TEXT)]), _heads(spark, o_a="1", o_b="1"), toy_model)
    vector = json.dumps([float(x) for x in toy_model()(["o/a/x.md\n" + TEXT])[0]])
    assert run("search", "--root", store.root, "--vector", vector, "--k", "1") == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["path"] == "x.md"
    assert run("caches", "--root", store.root, "--chunks", str(tmp_path / "cc"), "--vectors", str(tmp_path / "vc")) == 0
    assert run("dedup", "--root", store.root, "--out", str(tmp_path / "d")) == 0
    assert "0 duplicate file pairs" in capsys.readouterr().out


def test_embedding_makes_few_texts_at_a_time(spark):
    def make():
        import tracemalloc
        tracemalloc.start()
        return lambda texts: [[float(tracemalloc.get_traced_memory()[0])] * (1 + len(texts[0]) % 2) for _ in texts]

    chunks = spark.range(2000).coalesce(1).select(F.lit("r").alias("repo"), F.lit("p").alias("path"), F.concat(
        F.repeat(F.lit("x"), 1500), F.col("id").cast("string")).alias("text"))
    rows = [r[0] for r in U.embed(chunks, make).select("embedding").collect()]
    assert len(rows) == 2000 and {len(v) for v in rows} == {1, 2}
    assert min(v[0] for v in rows) < 4.5e6                # the batch itself; as strings all texts take as much again


def test_chunks_are_written_once(spark, tmp_path):
    """Neither putting chunks nor asking the cache leaves a second copy of them on disk."""
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    tables = lambda: {p for p in folder.iterdir() if p.name.startswith("table-")}
    store, before = IndexStore(spark, str(tmp_path / "ix")), tables()
    store.put_chunks(_chunk_rows(spark, [("r1", "a.rs", 1, "t"), ("r1", "b.rs", 1, "u"), ("r2", "c.rs", 1, "v")]))
    store.put_chunks(_chunk_rows(spark, [("r1", "a.rs", 7, "w"), ("r3", "d.rs", 1, "x")]))
    place = lambda df: sorted((r.repo, r.path) for r in df.collect())
    assert place(store.chunks()) == place(store.files()) == [("r1", "a.rs"), ("r2", "c.rs"), ("r3", "d.rs")]
    store.put_chunks(store.chunks().where("false"))
    assert store.chunks().count() == 3

    def make():
        def model(texts):
            assert not any(t.endswith(("w", "v")) for t in texts)
            return [[9.0, float(len(t))] for t in texts]
        return model

    asked = store.chunks().select("repo", "path", "start_line", "text").unionByName(spark.range(40).select(
        F.lit("r4").alias("repo"), F.lit("e.rs").alias("path"), F.col("id").cast("int").alias("start_line"),
        F.repeat(F.lit("y"), F.col("id").cast("int")).alias("text")))
    cache = U.vector_cache(store.chunks().where("repo <> 'r3'"))
    got = {(r.repo, r.start_line): r.embedding for r in
           U.embed_missing(asked.withColumn("embedding", F.lit(None).cast("array<float>")), cache, make).collect()}
    assert got == {("r1", 7): [7.0] * 4, ("r2", 1): [1.0] * 4, ("r3", 1): [9.0, 9.0],
                   **{("r4", i): [9.0, 8.0 + i] for i in range(40)}}
    only_known = store.chunks().where("repo <> 'r3'")
    assert {tuple(r.embedding) for r in U.embed_missing(only_known, cache, make).collect()} == {(7.0,) * 4, (1.0,) * 4}
    assert tables() == before
