"""Working trees and listings as DataFrames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import text as T


def decode_text(content: Column, max_bytes: int | None = None) -> Column:
    """File bytes as text, broken UTF-8 replaced; NULL for a file that holds a NUL anywhere or is
    larger than `max_bytes`."""
    text = F.when(~content.cast("string").contains("\0"), F.make_valid_utf8(content.cast("string")))
    return text if max_bytes is None else F.when(F.octet_length(content) <= max_bytes, text)


def paths_to_repos(files: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """`files` inside a root of roots(repo, root), plus `repo` and `root`: those of the innermost root.
    `path` becomes relative to it. Of repositories with one root the first by name has it; roots
    end without a slash. Files outside all roots, and null paths, give no rows.

    One join for each depth that roots have (their distinct numbers reach the driver, as many as a
    path has parts at most), deepest first: a file stays one row, is scanned once and its content is
    shuffled only if Spark finds the roots too large to broadcast."""
    parts = F.size(F.split("root", "/"))
    roots = roots.where("root IS NOT NULL").groupBy("root").agg(F.min("repo").alias("repo"))
    depths = sorted((r[0] for r in roots.select(parts).distinct().collect()), reverse=True)
    names = []
    for d in depths:
        prefix, repo = f"_root{d}", f"_repo{d}"
        here = roots.where(parts == d).select(F.col("root").alias(prefix), F.col("repo").alias(repo))
        inside = F.when(F.size(F.split(path, "/")) > d, F.substring_index(path, "/", d))
        files = files.join(here, inside == F.col(prefix), "left")
        names.append((prefix, repo))
    if not names:
        return files.withColumn("repo", F.lit(None).cast("string")).withColumn("root", F.lit(None).cast("string")).where("false")
    found = F.coalesce(*[F.when(F.col(p).isNotNull(), F.struct(F.col(p).alias("root"), F.col(r).alias("repo"))) for p, r in names])
    return (files.withColumn("_found", found).where("_found IS NOT NULL")
            .withColumn("root", F.col("_found.root")).withColumn("repo", F.col("_found.repo"))
            .withColumn(path, F.substr(F.col(path), F.length("root") + 2))
            .drop("_found", *[x for pair in names for x in pair]))


def read_trees(spark: SparkSession, dirs: dict[str, str]) -> DataFrame:
    """Files below the folders of `dirs` (repository to folder) as (repo, path, content, sha), unwanted
    paths left out at once. One scan for any number of folders, nested ones too."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def full(folder):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return p.getFileSystem(conf).makeQualified(p).toString().rstrip("/")

    roots = {repo: full(d) for repo, d in dirs.items()}
    known = set(roots.values())
    outer = [r for r in sorted(known) if not any(r[:i] in known for i, c in enumerate(r) if c == "/")]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(outer)
    listed = spark.createDataFrame(list(roots.items()), "repo string, root string")
    return (paths_to_repos(raw.select("path", "content"), listed)
            .where(T.wanted(F.col("path")) & (T.path_lang(F.col("path")) != ""))
            .select("repo", "path", "content", F.sha2("content", 256).alias("sha")))


def read_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    return read_trees(spark, {repo: root})


def texts(files: DataFrame) -> DataFrame:
    return files.withColumn("text", decode_text(F.col("content"))).where("text IS NOT NULL").drop("content")


def list_repos(spark: SparkSession, path: str) -> DataFrame:
    """Names worth indexing out of a saved repository listing."""
    return indexable_repos(spark.read.schema(schemas.REPO_LISTING).json(path))


def indexable_repos(listing: DataFrame) -> DataFrame:
    return (listing.where("NOT coalesce(fork, false) AND NOT coalesce(archived, false) "
                          "AND coalesce(size, 0) <> 0").select("name").orderBy("name"))


def slug_of_url(url: Column) -> Column:
    """org/name of a clone's remote, lower case."""
    bare = F.regexp_replace(url, r"^.*github\.com[:/]", "")
    return F.lower(F.regexp_replace(bare, r"\.git$", ""))


def local_clones(clones: DataFrame, indexed: DataFrame) -> DataFrame:
    """clones(name, url), indexed(repo) -> (repo, name); the last name wins per repo."""
    keyed = clones.withColumn("_slug", slug_of_url(F.col("url")))
    return (indexed.select("repo", F.lower("repo").alias("_slug")).distinct().join(keyed, "_slug")
            .groupBy("repo").agg(F.max("name").alias("name")))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GROUPS).json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored ledger, one JSON object a line as `dedup` writes it; None where the path is not there.
    Any other fault is raised."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(schemas.LEDGER).json(path)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Exported log: one JSON object per commit."""
    return spark.read.schema("repo string, sha string, ts long, subject string, merge boolean, "
                             "changes array<struct<status: string, path: string>>").json(path)
