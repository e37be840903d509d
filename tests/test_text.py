"""Column functions, chunking, history and sources."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codeweft import constants as K
from codeweft.functions import text as T
from codeweft.operators import chunking, history
from codeweft.operators.syntax import spans_of
from codeweft.sources import files


def _map(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_paths(spark):
    assert _map(spark, ["a/b.RS", "README", ".gitignore", "x.tar.gz", "a.b/c", "..py", ".a.py"], T.extension) == \
        [".rs", "", "", ".gz", "", "", ".py"]
    assert _map(spark, ["src/a.ts", "node_modules/x/i.js", "a/dist/b.js", "dist", "x.min.js", "Cargo.lock",
                        "package-lock.json", "my/package-lock.json.ts"], T.wanted) == \
        [True, False, False, True, False, False, False, True]
    assert _map(spark, ["a/tests/b.rs", "tests/b.rs", "x/test_a.py", "a.spec.ts", "b.d.ts", "src/a.rs",
                        "latest/x.rs"], T.excluded_path) == [True, False, True, True, True, False, False]


def test_clean_query(spark):
    assert _map(spark, ["  speed up the parser (#7) ", "MERGE branch into main", "bump all the versions", "WIP",
                        "wip on the parser", "short one", "Reverting is a verb too"], T.clean_query) == \
        ["speed up the parser", None, None, None, "wip on the parser", "short one", None]


def test_tokens(spark):
    got = set(_map(spark, ["Use the parseHeaderLine of net_io/v2/read.go"], T.tokens)[0])
    assert got == {"parse", "header", "line", "net", "io", "v2", "read", "go"}
    assert set(_map(spark, ["テスト 関数 HTTPServer2Go K x"], T.tokens)[0]) == {"テスト", "関数", "httpserver2", "go"}


def test_embed_text_and_hash(spark):
    text = "é" * 2500
    row = spark.createDataFrame([(text,)], "t string").select(
        T.embed_text(F.lit("o/r"), F.lit("p"), F.col("t")).alias("e"),
        F.hex(T.text_hash(T.embed_text(F.lit("o/r"), F.lit("p"), F.col("t")))).alias("h")).first()
    assert row["e"] == "o/r/p\n" + text
    assert row["h"].lower() == hashlib.sha256((K.MODEL_NAME + "\0" + row["e"]).encode()).hexdigest()


def _brute_windows(lines, first, last):
    out, start = [], first
    while start <= last:
        end = min(start + 79, last)
        part = lines[start:end + 1]
        if sum(bool(x.strip()) for x in part) >= 1:
            out.append((start + 1, end + 1, "", "\n".join(part)))
        if end == last:
            break
        start = end - 14
    return out


def test_windows_agree_with_brute_force(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["", " ", "　", "word " * rng.randint(1, 60)]) for _ in range(n))
             for n in (1, 2, 3, 79, 80, 81, 145, 146, 210, 211, 400)] + [""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {}
    for r in chunking.line_windows(df, "i").orderBy("i", "start_line").collect():
        got.setdefault(r["i"], []).append((r["start_line"], r["end_line"], r["symbol"], r["text"]))
    for i, t in enumerate(texts):
        lines = t.split("\n")
        assert got.get(i, []) == _brute_windows(lines, 0, len(lines) - 1)


PY = "import os\n\n\n" + "\n".join(f"x{i} = {i}" for i in range(5)) + """

@wraps
async def outer(a):
    def inner():
        return a
    return inner


class Big:
""" + "\n".join(f"    def m{i}(self):\n        return {i}\n" for i in range(120)) + "\nif os:\n    def late(): pass\n"


def _brute_chunks(text, spans):
    lines, out, seen = text.split("\n"), [], -1
    for s in spans:
        if s["start"] > seen + 1:
            out += _brute_windows(lines, seen + 1, s["start"] - 1)
        if s["end"] > seen:
            out.append((s["start"] + 1, s["end"] + 1, s["symbol"], "\n".join(lines[s["start"]:s["end"] + 1])))
            seen = s["end"]
    if seen + 1 < len(lines):
        out += _brute_windows(lines, seen + 1, len(lines) - 1)
    return sorted(out)


def test_python_chunks(spark):
    spans = spans_of(PY, "python")
    names = [s["symbol"] for s in spans]
    assert "outer" in names and "inner" not in names and "m119" in names and "Big" not in names and "late" in names
    assert spans[0] == {"start": 9, "end": 13, "symbol": "outer"}
    df = spark.createDataFrame([("a.py", PY), ("b.md", "\n".join(f"line {i}" for i in range(200))),
                                ("c.bin", "a\nb\nc\nd"), ("d.md", "\n\n\n\n"), ("e.rs", "a\nb\nc\n"),
                                ("f.py", "def broken(:\n  x\n  y\n")], "path string, text string")
    got = {}
    for r in chunking.chunk_files(df).collect():
        got.setdefault(r["path"], []).append((r["start_line"], r["end_line"], r["symbol"], r["text"]))
    assert sorted(got["a.py"]) == _brute_chunks(PY, spans)
    assert [g[:3] for g in sorted(got["b.md"])] == [(1, 80, ""), (66, 145, ""), (131, 200, "")]
    assert "c.bin" not in got and "d.md" not in got
    assert [g[:2] for g in got["e.rs"]] == [(1, 4)] and [g[:2] for g in got["f.py"]] == [(1, 4)]


def test_overlapping_spans_agree_with_brute_force(spark):
    rng = random.Random(9)
    cases = []
    for i in range(60):
        n = rng.randint(1, 120)
        spans = sorted((s, min(s + rng.randint(0, 30), n - 1), f"f{j}") for j, s in
                       enumerate(rng.randint(0, n - 1) for _ in range(rng.randint(0, 6))))
        cases.append((i, "\n".join(f"l{k}" for k in range(n)), [{"start": a, "end": b, "symbol": c} for a, b, c in spans]))
    df = spark.createDataFrame(cases, "i int, text string, spans array<struct<start:int,end:int,symbol:string>>")
    lines = df.withColumn("_lines", F.split("text", "\n", -1))
    segs = chunking._segments(F.col("spans"), F.size("_lines"))
    got = {r["i"]: [(s["gap"], s["first"], s["last"], s["symbol"]) for s in r["g"]]
           for r in lines.select("i", segs.alias("g")).collect()}
    for i, text, spans in cases:
        n, seen, want = len(text.split("\n")), -1, []
        for s in spans:
            if s["start"] > seen + 1:
                want.append((True, seen + 1, s["start"] - 1, ""))
            if s["end"] > seen:
                want.append((False, s["start"], s["end"], s["symbol"]))
                seen = s["end"]
        if seen + 1 < n:
            want.append((True, seen + 1, n - 1, ""))
        assert got[i] == want


def test_tree_is_read(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"ok \xff tail")
    (tmp_path / "src/b.rs").write_bytes(b"a\0b")
    (tmp_path / "src/big.rs").write_bytes(b"x" * 300_001)
    (tmp_path / "node_modules/c.js").write_text("x")
    (tmp_path / "notes.bin").write_text("x")
    (tmp_path / "src/late.rs").write_bytes(b"x" * 9_000 + b"\0")
    tree = files.read_tree(spark, str(tmp_path), "o/r")
    assert {r["path"] for r in tree.collect()} == {"src/a.py", "src/b.rs", "src/big.rs", "src/late.rs"}
    assert {(r["path"], r["text"]) for r in files.texts(tree).collect()} == {("src/a.py", "ok � tail"), ("src/big.rs", "x" * 300_001)}


def test_many_trees_are_one_scan(spark, tmp_path):
    """Nested folders, one whose name begins like another's, and twenty more: one scan in the plan."""
    dirs = {"o/a": "a", "o/in": "a/sub/in", "o/ab": "a-b", **{f"o/r{i}": f"r{i}" for i in range(20)}}
    for repo, d in dirs.items():
        (tmp_path / d / "src").mkdir(parents=True)
        (tmp_path / d / "src/f.py").write_text(repo)
    (tmp_path / "a/sub/top.py").write_text("o/a")
    tree = files.read_trees(spark, {r: str(tmp_path / d) for r, d in dirs.items()})
    got = {(r["repo"], r["path"]): bytes(r["content"]).decode() for r in tree.collect()}
    assert got == {**{(r, "src/f.py"): r for r in dirs}, ("o/a", "sub/top.py"): "o/a"}
    plan = tree._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("binaryFile") == 1 and "Union" not in plan


def test_paths_to_repos(spark):
    roots = [("x", "a/b"), ("y", "a/b/c"), ("w", "a/b"), ("z", "q"), (None, "a/b/n"), ("v", None)]
    paths = ["a/b/1.py", "a/b/c/2.py", "a/b/c/d/3.py", "a/b", "a/bc/4.py", "q/5.py", "6.py", None, "a/b/n/7.py"]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, i int")
    got = {(r["i"], r["repo"], r["path"]) for r in files.paths_to_repos(df, spark.createDataFrame(roots, "repo string, root string")).collect()}
    assert got == {(0, "w", "1.py"), (1, "y", "2.py"), (2, "y", "d/3.py"), (5, "z", "5.py"), (8, None, "7.py")}
    assert files.paths_to_repos(df, spark.createDataFrame([], "repo string, root string")).count() == 0


def test_listing_and_clones(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"name":"b","size":3}\n{"name":"a","size":1,"fork":false}\n'
                                     '{"name":"f","size":1,"fork":true}\n{"name":"z","size":0}\n'
                                     '{"name":"o","size":4,"archived":true}\n')
    assert [r[0] for r in files.list_repos(spark, str(tmp_path / "l.json")).collect()] == ["a", "b"]
    clones = spark.createDataFrame([("one", "git@github.com:Org/X.git"), ("two", "https://github.com/org/x"),
                                    ("three", "https://else.where/org/y")], "name string, url string")
    got = files.local_clones(clones, spark.createDataFrame([("org/X",), ("org/y",)], "repo string"))
    assert [tuple(r) for r in got.collect()] == [("org/X", "two")]


def test_indexable_changes(spark):
    rows = [("A", "lib/io.go"), ("D", "lib/old.go"), ("M", "lib/io_test.go"), ("M", "tests/io.go"),
            ("M", "vendor/z/io.go"), ("M", "lib/io.jpeg")]
    df = spark.createDataFrame(rows, "s string, p string")
    assert [r["p"] for r in df.where(T.indexable_change(F.col("s"), F.col("p"))).collect()] == \
        ["lib/io.go", "tests/io.go"]


def test_commit_mining(spark):
    commits = spark.createDataFrame([("o/r", "1", 10, "Initial commit", False), ("o/r", "2", 20, "answer with both halves (#4)", False),
                                     ("o/r", "3", 30, "touch more files than allowed", False),
                                     ("o/r", "4", 40, "arrives through a merge", True), ("o/r", "5", 5, "older than the window", False)],
                                    "repo string, sha string, ts long, subject string, merge boolean")
    changes = spark.createDataFrame([("o/r", s, "M", p) for s, p in
                                     [("1", "a.py"), ("2", "b.py"), ("2", "a.py"), ("2", "x.png"), ("4", "a.py"), ("5", "a.py")]
                                     + [("3", f"f{i}.py") for i in range(11)]],
                                    "repo string, sha string, status string, path string")
    got = {r["sha"]: (r["query"], r["files"]) for r in history.collect_queries(commits, changes, since=6).collect()}
    two = ("answer with both halves", ["a.py", "b.py"])
    assert got == {"2": two, "3": ("touch more files than allowed", sorted(f"f{i}.py" for i in range(11)))}
    got = history.collect_queries(commits, changes, since=6, max_files=10, min_chars=12).collect()
    assert [(r["query"], r["files"]) for r in got] == [two]


DIFF = """diff --git a/f.py b/f.py
--- a/f.py
+++ b/f.py
@@ -2,0 +3,4 @@ class Reader
+
@@ -9 +12 @@
@@ -20,2 +30,0 @@
--- a/g.py
+++ /dev/null
@@ -1,2 +0,0 @@
@@ -1 +5 @@""".split("\n")


def test_added_ranges_and_chunks(spark):
    df = spark.createDataFrame([("c", i, ln) for i, ln in enumerate(DIFF)], "change string, line_no int, line string")
    ranges = history.added_ranges(df)
    assert [tuple(r) for r in ranges.orderBy("first").collect()] == [("c", "f.py", 3, 6), ("c", "f.py", 12, 12)]
    rng = random.Random(2)
    spans = [("c", "f.py", a, a + rng.randint(0, 12), i) for i, a in enumerate(rng.randint(1, 60) for _ in range(80))]
    adds = [("c", "f.py", a, a + rng.randint(0, 4)) for a in (rng.randint(1, 70) for _ in range(6))]
    got = history.changed_chunks(
        spark.createDataFrame(spans, "change string, path string, start_line int, end_line int, n int"),
        spark.createDataFrame(adds, "change string, path string, first int, last int"))
    assert {r["n"] for r in got.collect()} == \
        {n for _, _, s, e, n in spans if any(s <= b and e >= a for _, _, a, b in adds)}


def test_heavy_rows_are_dealt_to_bounded_tasks(spark, tmp_path):
    from codeweft.session import spread
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    scan = spark.read.parquet(f"{tmp_path}/t")
    for rows in (40, 10):
        dealt = spread(scan, rows)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1000 and max(sizes) <= 2 * rows
    assert spread(scan, 5000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
