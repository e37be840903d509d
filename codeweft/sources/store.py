"""The index on a shared file system.

chunks/  copy-on-write table (versioned.py) in the order of (repo, path)
files/   the same: path and content digest of what was indexed
repos/   append-only (repo, commit_sha, indexed_at, version, seq); the last row counts
meta/    append-only (key, value, seq); the last row counts

A repository's commit row is appended after its chunks are in place, so a run that dies in
between leaves the old commit and the next run does that repository again. Repositories are told
by tables throughout: no list of names reaches the driver.
"""
from __future__ import annotations

import datetime
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..constants import MODEL_NAME
from ..operators import upkeep as U
from ..operators.chunking import chunk_files
from ..session import cut
from .files import texts
from .versioned import VersionedTable


FILES = "path string, sha string, repo string"
_REPO_LOG = schemas.REPOS + ", version long, seq long"


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, model: str = MODEL_NAME):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.chunk_table = VersionedTable(spark, self._path("chunks"), schemas.CHUNKS)
        self.file_table = VersionedTable(spark, self._path("files"), FILES)

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self, table: str, ddl: str) -> DataFrame:
        fs, p = self._fs(self._path(table))
        if not fs.exists(p):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(self._path(table))

    # -- reads
    def chunks(self) -> DataFrame:
        return self.chunk_table.read()

    def files(self) -> DataFrame:
        return self.file_table.read()

    def _heads(self) -> DataFrame:
        log = self._read("repos", _REPO_LOG)
        return U.upsert_latest(log, ["repo"], "seq").where("commit_sha IS NOT NULL").drop("seq")

    def repos(self) -> DataFrame:
        return self._heads().drop("version")

    def meta(self) -> DataFrame:
        log = self._read("meta", schemas.META + ", seq long")
        return U.upsert_latest(log, ["key"], "seq").where("value IS NOT NULL").drop("seq")

    def get_meta(self, key: str) -> str | None:
        row = self.meta().where(F.col("key") == key).first()
        return row["value"] if row else None

    def get_repo_commit(self, repo: str) -> str | None:
        row = self.repos().where(F.col("repo") == repo).first()
        return row["commit_sha"] if row else None

    def model_matches(self) -> bool:
        return self.get_meta("model") in (None, self.model)

    # -- writes
    def _append(self, table: str, rows: DataFrame) -> None:
        rows.withColumn("seq", F.lit(time.time_ns())).coalesce(1) \
            .write.mode("append").parquet(self._path(table))

    def set_meta(self, key: str, value: str | None) -> None:
        self._append("meta", self.spark.createDataFrame([(key, value)], schemas.META))

    def set_repo_commits(self, rows: DataFrame) -> None:
        """Record (repo, commit_sha, indexed_at) and, where there is one, the version of the commit."""
        version = F.col("version") if "version" in rows.columns else F.lit(None).cast("long")
        self._append("repos", rows.select("repo", "commit_sha", "indexed_at", version.alias("version")))

    def delete_repos(self, gone: DataFrame | list[str]) -> None:
        """Drop whole repositories, given as a table with `repo` or as a list."""
        if isinstance(gone, list):
            gone = self.spark.createDataFrame([(n,) for n in gone], "repo string")
        for table in (self.chunk_table, self.file_table):
            table.change(gone, on=["repo"])
        self.set_repo_commits(gone.select("repo", F.lit(None).cast("string").alias("commit_sha"),
                                          F.lit(None).cast("string").alias("indexed_at")))

    def delete_path(self, repo: str, path: str) -> int:
        """Drop one file of a repository, its digest too, so that a refresh finds it new; returns
        how many chunks it had."""
        gone = self.spark.createDataFrame([(repo, path)], "repo string, path string")
        held = self.chunk_table.files_with(gone)
        n = self.chunk_table.matching(gone, held).count()
        self.file_table.change(gone)
        self.chunk_table.change(gone, files=held)
        return n

    def put_chunks(self, chunks: DataFrame) -> None:
        """Replace the repositories that occur in `chunks`. Their files get a digest that no content
        has, so that a refresh takes each of them as changed."""
        put = self.chunk_table.replace(chunks, on=["repo"])
        self.file_table.change(put.select("repo").distinct(),
                               put.select("path", F.lit("").alias("sha"), "repo").distinct(), on=["repo"])

    def refresh(self, snapshot: DataFrame, heads: DataFrame, make_model, only=None,
                now: str | None = None, partial: bool = False) -> dict:
        """Bring the index to a snapshot(repo, path, content, sha) pinned at heads(repo, head[, version]).

        Unchanged repositories are skipped, changed ones are diffed by content digest, and only new
        texts reach the model: the old rows of changed files are the vector cache. Repositories that
        `heads` does not list are dropped, unless it is `partial` or `only` names a few. Of heads
        with a version, those older than the recorded one are passed over. A stale repository, a
        deleted and a changed file are all keys of one change to the table.
        """
        now = now or datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
        if not self.model_matches():
            for table in ("chunks", "files", "repos", "meta"):
                fs, p = self._fs(self._path(table))
                if fs.exists(p):
                    fs.delete(p, True)
        self.set_meta("model", self.model)
        stored = cut(self._heads())
        if "version" not in heads.columns:
            heads = heads.withColumn("version", F.lit(None).cast("long"))
        if only:
            heads = heads.where(F.col("repo").isin(list(only)))
        late = (heads.join(stored.select("repo", F.col("version").alias("_v")), "repo")
                .where("version < _v").select("repo"))
        work = cut(U.repo_plan(heads.join(late, "repo", "left_anti"), stored).where("action <> 'skip'"))
        stale = U.stale_repos(stored, heads).select("repo")
        stale = cut(stale.limit(0) if only or partial else stale)
        todo = work.select("repo")
        new_files = snapshot.join(todo, "repo", "left_semi")
        old_files = self.files().join(todo.unionByName(stale), "repo", "left_semi")
        changed = cut(U.change_set(old_files, new_files))
        fresh_text = texts(new_files.join(changed.where("status <> 'D'"), ["repo", "path"], "left_semi"))
        fresh = chunk_files(fresh_text.drop("sha"), "repo").withColumn("id", U.chunk_id())
        touched = self.chunk_table.files_with(changed)
        cache = U.vector_cache(self.chunk_table.matching(changed, touched)) if touched else None
        embedded = cut(U.embed_missing(fresh, cache, make_model))
        if not changed.isEmpty():
            self.chunk_table.change(changed, embedded, touched)
            live = new_files.join(changed, ["repo", "path"], "left_semi").select("path", "sha", "repo")
            self.file_table.change(changed, live)
        self.set_repo_commits(work.select("repo", F.col("head").alias("commit_sha"), F.lit(now).alias("indexed_at"), "version")
                              .unionByName(stale.select("repo", *[F.lit(None).cast(t).alias(c) for c, t in (
                                  ("commit_sha", "string"), ("indexed_at", "string"), ("version", "long"))])))
        self.set_meta("updated_at", now)
        return {"repos_updated": work.count(), "chunks_added": embedded.count(), "total": self.chunks().count()}


class CallGraphStore:
    """symbols/ and refs/ partitioned by repo, plus the same two logs."""

    def __init__(self, spark: SparkSession, root: str):
        self._s = IndexStore(spark, root)

    def tables(self) -> dict[str, DataFrame]:
        s = self._s
        repos = U.upsert_latest(s._read("repos", schemas.CALL_REPOS + ", seq long"), ["repo"], "seq")
        return {"symbols": s._read("symbols", schemas.SYMBOLS), "refs": s._read("refs", schemas.REFS),
                "repos": repos.drop("seq"), "meta": s.meta()}

    def put(self, graph, commits: DataFrame, now: str | None = None) -> None:
        """Replace the graph's repositories; commits(repo, commit_sha, tool)."""
        from ..constants import SCHEMA_VERSION
        now = now or datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
        for table, rows in (("symbols", graph.symbols), ("refs", graph.refs)):
            (rows.hint("rebalance", "repo").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("repo").parquet(self._s._path(table)))
        self._s._append("repos", commits.select("repo", "commit_sha", F.lit(now).alias("indexed_at"), "tool"))
        for key, value in (("generator", "codeweft.scip"), ("schema_version", SCHEMA_VERSION),
                           ("updated_at", now)):
            self._s.set_meta(key, value)
