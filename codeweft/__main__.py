"""Command line over an index root: python -m codeweft <command> ..."""
from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .constants import SIM_THRESHOLD
from .operators import callgraph, duplicates, forest, history, knn, metrics, scip, upkeep
from .operators.features import group_features, label
from .session import build_session
from .sources import files, scip_json
from .sources.store import CallGraphStore, IndexStore


def _vector(text: str):
    """A query vector given as JSON or as @file."""
    if text.startswith("@"):
        with open(text[1:]) as fh:
            text = fh.read()
    return json.loads(text)


def _index(spark, a):
    """Bring the index to the working trees listed in a manifest of {repo: {dir, head}}."""
    with open(a.manifest) as fh:
        listed = json.load(fh)
    if a.only:
        listed = {r: v for r, v in listed.items() if r in set(a.only.split(","))}
    if not listed:
        print("no repositories listed", file=sys.stderr)
        return 1
    trees = files.read_trees(spark, {repo: v["dir"] for repo, v in listed.items()})
    heads = spark.createDataFrame([(r, v["head"]) for r, v in listed.items()], "repo string, head string")
    stats = IndexStore(spark, a.root).refresh(trees, heads, upkeep.fastembed_model(),
                                              only=list(listed) if a.only else None)
    print(json.dumps(stats))
    return 0


def _merge(spark, a):
    parts = [IndexStore(spark, p) for p in a.parts]
    merged = upkeep.merge_parts([{"chunks": p.chunks(), "repos": p.repos(), "meta": p.meta()} for p in parts])
    out = IndexStore(spark, a.root)
    out.set_meta("model", out.model)
    out.put_chunks(merged["chunks"].withColumn("id", upkeep.chunk_id()))
    out.set_repo_commits(merged["repos"])
    return 0


def _shard(spark, a):
    i, n = (int(x) for x in a.shard.split("/", 1))
    upkeep.stride_shard(IndexStore(spark, a.root).chunks(), i, n).write.mode("overwrite").parquet(a.out)
    return 0


def _caches(spark, a):
    store = IndexStore(spark, a.root)
    upkeep.chunk_cache(store.repos(), store.chunks()).write.mode("overwrite").partitionBy("repo").parquet(a.chunks)
    upkeep.store_cache(upkeep.vector_cache(store.chunks()), a.vectors)
    return 0


def _dedup(spark, a):
    from .session import cut
    pairs = cut(duplicates.find_pairs(duplicates.analysis_set(IndexStore(spark, a.root).chunks()), a.threshold))
    fresh = duplicates.new_pairs(pairs, files.read_ledger(spark, a.baseline) if a.baseline else None)
    duplicates.in_report_order(pairs).write.mode("overwrite").json(a.out)
    if a.new_out:
        duplicates.in_report_order(fresh).write.mode("overwrite").json(a.new_out)
    print(f"{pairs.count()} duplicate file pairs, {fresh.count()} new")
    return 0


def _similar(spark, a):
    """Added code that already exists elsewhere: a zero-context diff plus the changed files."""
    lines = spark.read.text(a.diff, wholetext=True).select(F.posexplode(F.split("value", "\n", -1))
                                                           .alias("line_no", "line"))
    ranges = history.added_ranges(lines.withColumn("change", F.lit("diff")))
    tree = files.texts(files.read_tree(spark, a.tree, a.repo))
    from .operators.chunking import chunk_files
    chunks = chunk_files(tree.drop("sha"), "repo").withColumn("change", F.lit("diff"))
    touched = history.changed_chunks(chunks, ranges)
    asked = upkeep.embed(touched, upkeep.fastembed_model()) \
        .withColumn("qid", F.concat_ws(":", "path", F.col("start_line").cast("string")))
    found = knn.nearest_foreign(asked.withColumn("own_repo", F.lit(a.repo)), IndexStore(spark, a.root).chunks(),
                                a.threshold)
    shown = found.select("qid", F.concat_ws("/", "repo", "path").alias("other"), "symbol", "cos") \
        .join(asked.select("qid", "path", "start_line", "end_line"), "qid")
    for row in shown.toLocalIterator():
        print(json.dumps(row.asDict()))
    return 0


def _search(spark, a):
    store = IndexStore(spark, a.root)
    ledger = files.read_ledger(spark, a.ledger) if a.ledger else None
    if ledger is not None:
        ledger = duplicates.both_directions(ledger)
    for row in knn.semantic_search(store.chunks(), _vector(a.vector), a.k, a.repo, ledger):
        print(json.dumps(row))
    return 0


def _scip(spark, a):
    graph = scip.ingest(scip_json.load(spark, a.json, a.repo))
    tool = a.tool or scip_json.tool_name(spark, a.json)
    CallGraphStore(spark, a.root).put(graph, spark.createDataFrame(
        [(a.repo, a.commit, tool)], "repo string, commit_sha string, tool string"))
    for row in graph.stats.collect():
        print(row.asDict())
    return 0


def _calls(spark, a):
    if not a.symbol and not a.path:
        print("calls: give --symbol or --path", file=sys.stderr)
        return 2
    try:
        answer = callgraph.find_callers(CallGraphStore(spark, a.root).tables(), a.symbol, a.repo, a.path,
                                        a.lines, a.k)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    print(json.dumps({"truncated": answer.truncated, "meta": answer.meta}))
    found = False
    for part, rows in (("target", answer.targets.orderBy("via_impl", "repo", "path", "start_line", "id")),
                       ("caller", answer.callers.orderBy("repo", "path", "line", "name")),
                       ("repo", answer.freshness.orderBy("repo"))):
        for row in rows.toLocalIterator():
            found = True
            print(json.dumps({"part": part, **row.asDict()}))
    return 0 if found else 1


def _dataset(spark, a):
    """Query groups from an exported commit log."""
    log = files.read_commits(spark, a.commits)
    commits = log.drop("changes")
    changes = log.select("repo", "sha", F.explode("changes").alias("c")).select("repo", "sha", "c.*")
    queries = history.collect_queries(commits, changes, a.since)
    asked = queries.select(F.concat_ws("@", "repo", "sha").alias("qid"), F.lit("").alias("repo"),
                           F.lit("").alias("path"), F.col("query").alias("text"))
    # a query is embedded as it is, without the file prefix of a chunk
    asked = upkeep.embed(asked, upkeep.fastembed_model(), batch=16, raw=True)
    chunks = IndexStore(spark, a.root).chunks()
    near = knn.batch_top_k(asked, chunks, a.k).drop("rank")
    meta = chunks.select("id", "repo", "path", "start_line", "end_line", "symbol", "lang",
                         F.length("text").alias("text_len"))
    labelled = label(near.join(meta, "id"), history.touched_files(queries))
    history.build_groups(queries, labelled).write.mode("overwrite").json(a.out)
    return 0


def _train(spark, a):
    kept = forest.kept_features([f for f in a.drop_features.split(",") if f])
    groups = files.read_groups(spark, a.data)
    if not a.keep_negative_groups:
        groups = groups.where("n_pos > 0")
    split = metrics.time_split(groups, a.split)
    rows = group_features(history.explode_groups(split, False, "part"))
    from .session import cut
    rows = cut(rows)
    model = forest.train(rows.where("part <> 'test'").withColumn("_valid", F.col("part") == "valid"), kept,
                         rounds=a.rounds, validation="_valid")
    plain = forest.from_gbt(model, kept, 0.5)
    scored = cut(forest.Forest.of(plain).apply(rows))
    train, test = scored.where("part <> 'test'"), scored.where("part = 'test'")
    report = {"model": metrics.evaluate(train, test), "features": kept,
              "train": metrics.conditions(train).first().asDict(),
              "test": metrics.conditions(test).first().asDict(),
              "importance": dict(forest.importances(model, kept))}
    base_train, base_test = metrics.baseline_scores(train), metrics.baseline_scores(test)
    report["baseline_cos"] = metrics.evaluate(train, test, "cos")
    report["baseline_repo"] = metrics.prf(test, F.col("same_repo") > 0).first().asDict()
    report["baseline_repo_and_cos"] = metrics.evaluate(base_train, base_test, "repo_and_cos", "repo_first")
    report["baseline_fixed_cos"] = {"threshold": SIM_THRESHOLD,
                                    **metrics.prf(test, F.col("cos") >= SIM_THRESHOLD).first().asDict()}
    plain["threshold"] = report["model"]["threshold"]
    with open(a.out_model, "w") as fh:
        json.dump(plain, fh)
    print(json.dumps(report, indent=1))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeweft")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, root=True, **options):
        c = sub.add_parser(name)
        if root:
            c.add_argument("--root", required=True)
        for opt, kw in options.items():
            c.add_argument(f"--{opt.replace('_', '-')}", **kw)
        c.set_defaults(run=run)
        return c

    need, text = {"required": True}, {"default": ""}
    command("index", _index, manifest=need, only=text)
    command("merge", _merge).add_argument("parts", nargs="+")
    command("shard", _shard, shard=need, out=need)
    command("caches", _caches, chunks=need, vectors=need)
    command("dedup", _dedup, out=need, baseline=text, new_out=text,
            threshold={"type": float, "default": SIM_THRESHOLD})
    command("similar", _similar, repo=need, tree=need, diff=need,
            threshold={"type": float, "default": SIM_THRESHOLD})
    command("search", _search, vector=need, repo=text, ledger=text, k={"type": int, "default": 8})
    command("scip", _scip, repo=need, json=need, commit=text, tool=text)
    command("calls", _calls, symbol=text, repo=text, path=text, lines=text,
            k={"type": int, "default": 30}, json={"action": "store_true"})
    command("dataset", _dataset, commits=need, out=need, since={"type": int, "default": 1735689600},
            k={"type": int, "default": 30})
    command("train", _train, root=False, data=need, out_model=need, drop_features=text,
            split={"type": float, "default": 0.8}, rounds={"type": int, "default": 400},
            keep_negative_groups={"action": "store_true"})
    return p


def main(argv=None) -> int:
    args = parser().parse_args(argv)
    return args.run(build_session(), args)


if __name__ == "__main__":
    sys.exit(main())
