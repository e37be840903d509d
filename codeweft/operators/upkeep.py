"""Incremental index upkeep: what changed, what to drop, what to embed, how parts merge."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K, schemas
from ..constants import MODEL_NAME
from ..functions import text as T
from ..session import cut, parallelism
from .ordering import rank_in_group


def repo_plan(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """listed(repo, head), stored(repo, commit_sha) -> action per listed repo."""
    return (listed.join(stored.select("repo", "commit_sha"), "repo", "left")
            .withColumn("action", F.when(F.col("commit_sha").isNull(), "full")
                        .when(F.col("commit_sha") == F.col("head"), "skip").otherwise("diff")))


def stale_repos(stored: DataFrame, listed: DataFrame) -> DataFrame:
    return stored.join(listed.select("repo"), "repo", "left_anti")


def change_set(old: DataFrame, new: DataFrame, keys=("repo", "path"), digest: str = "sha") -> DataFrame:
    """A / M / D per key between two snapshots; unchanged keys are left out."""
    o = old.select(*keys, F.col(digest).alias("_o"))
    n = new.select(*keys, F.col(digest).alias("_n"))
    status = (F.when(F.col("_o").isNull(), "A").when(F.col("_n").isNull(), "D")
              .when(F.col("_o") != F.col("_n"), "M"))
    return (o.join(n, list(keys), "full").withColumn("status", status)
            .where("status IS NOT NULL").select(*keys, "status"))


def upsert_latest(rows: DataFrame, keys: list[str], version: str | Column) -> DataFrame:
    """Last version of every key. A max over the row combines before the shuffle, so a key
    with a huge history costs one row per task."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.col(version) if isinstance(version, str) else version
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in `gone`."""
    return rows.join(gone.select(*keys), keys, "left_anti").select(*rows.columns)


def apply_changes(chunks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Index after a diff: every changed path is dropped, its new chunks are added."""
    return without(chunks, changed, ["repo", "path"]).unionByName(fresh)


def chunk_id() -> Column:
    """Content-free id of a chunk: the same at every refresh that leaves it where it is."""
    return F.md5(F.concat_ws("\0", "repo", "path", F.col("start_line").cast("string"),
                             F.col("end_line").cast("string"), "symbol"))


def stride_shard(chunks: DataFrame, shard: int, of: int) -> DataFrame:
    """Every `of`-th chunk of each repository, in (path, start_line, end_line, id) order. Only these keys
    are ordered; texts and vectors meet the chosen ones in one join. Keys tell chunks apart; null ones
    belong to no shard."""
    if not 0 <= shard < of:
        raise ValueError(f"bad shard {shard}/{of}")
    keys = ["repo", "path", "start_line", "end_line", "id"]
    ranked = rank_in_group(chunks.select(*keys), ["repo"], keys[1:], "_at")
    mine = ranked.where(F.col("_at") % of == shard).select(*keys).distinct()
    return chunks.join(mine, keys, "left_semi")


def sha_conflicts(repos: DataFrame) -> DataFrame:
    """Repositories that the parts of a merge pinned at different commits."""
    return (repos.groupBy("repo").agg(F.min("commit_sha").alias("first_sha"),
                                      F.max("commit_sha").alias("last_sha"))
            .where("first_sha <> last_sha"))


def merge_parts(parts: list[dict[str, DataFrame]], model: str = MODEL_NAME) -> dict[str, DataFrame]:
    """Concatenate index parts; refuses a foreign model or a repo at two commits."""
    def union(name):
        out = parts[0][name]
        for p in parts[1:]:
            out = out.unionByName(p[name])
        return out

    for i, p in enumerate(parts):
        held = p["meta"].where("key = 'model'").select("value").first()
        if held is None or held[0] != model:
            raise ValueError(f"part {i}: embedding model mismatch ({held and held[0]})")
    repos = union("repos")
    clash = sha_conflicts(repos).first()
    if clash:
        raise ValueError(f"{clash['repo']} pinned at {clash['first_sha'][:8]} and "
                         f"{clash['last_sha'][:8]}: parts must share one list of commits")
    return {"chunks": union("chunks"),
            "repos": upsert_latest(repos, ["repo"], "indexed_at"),
            "meta": parts[0]["meta"]}


def with_hash(chunks: DataFrame, model: str = MODEL_NAME) -> DataFrame:
    return chunks.withColumn("hash", T.text_hash(
        T.embed_text(F.col("repo"), F.col("path"), F.col("text")), model))


def vector_cache(chunks: DataFrame) -> DataFrame:
    """hash -> vector of a finished index; the last id wins where a hash repeats."""
    return with_hash(chunks).groupBy("hash").agg(F.max_by("embedding", "id").alias("embedding"))


def store_cache(cache: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Write a vector cache bucketed and sorted by hash, one file a bucket, and open it. Joined on the
    hash it is neither shuffled nor sorted again, as long as `buckets` are no fewer than the shuffle
    partitions of the session that joins (by default those of this one)."""
    spark = cache.sparkSession
    buckets = buckets or parallelism(spark)
    name = f"vector_cache_{uuid.uuid4().hex}"
    (cache.select("hash", "embedding").repartition(buckets, "hash").write.mode("overwrite").format("parquet")
     .bucketBy(buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name))
    return spark.table(name)


def open_cache(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A cache that `store_cache` wrote with so many buckets, in another session."""
    name = f"vector_cache_{uuid.uuid4().hex}"
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({schemas.VECTOR_CACHE.replace('array<float>', 'ARRAY<FLOAT>')}) USING parquet "
              f"CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def split_by_cache(chunks: DataFrame, cache: DataFrame, stored: bool = False) -> DataFrame:
    """Chunks with the cached vector, NULL where the model has to be run. Of a `stored` cache only the
    chunks' side is shuffled."""
    return with_hash(chunks.drop("embedding")).join(cache.hint("merge") if stored else cache, "hash", "left")


def chunk_cache(repos: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per chunk with its repo's commit; a repo without chunks keeps one NULL row.

    Kept flat and joined on (repo, commit_sha): a repository is never folded into one value.
    """
    cols = ["path", "start_line", "end_line", "symbol", "lang", "text"]
    pins = repos.select("repo", "commit_sha")
    held = chunks.select("repo", *cols).join(pins, "repo", "left")       # a hot repository can be split here
    empty = pins.join(chunks.select("repo").distinct(), "repo", "left_anti").select(
        "repo", *[F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in cols], "commit_sha")
    return held.unionByName(empty).select("repo", F.coalesce("commit_sha", F.lit("")).alias("commit_sha"), *cols)


def reusable(cache: DataFrame, pins: DataFrame) -> DataFrame:
    """Cached chunks of repositories whose pinned commit has not moved."""
    return (cache.join(pins, ["repo", "commit_sha"], "left_semi")
            .where("path IS NOT NULL"))


Embedder = Callable[[list[str]], np.ndarray]
_VECTORS = pa.list_(pa.float32())


def _vectors(rows) -> pa.Array:
    """Rows of a matrix, or vectors of any lengths, as an Arrow list column."""
    rows = [np.asarray(r, dtype=np.float32) for r in rows]
    ends = np.cumsum([0, *(len(r) for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.float32)))


def embed(chunks: DataFrame, make_model: Callable[[], Embedder], batch: int = 8,
          raw: bool = False, max_chars: int | None = K.EMBED_MAX_CHARS) -> DataFrame:
    """Run the model over chunks without a vector. One model per task, Arrow batches in.

    `make_model` is called on the worker, so the model itself is never shipped; of an Arrow batch `batch`
    texts at a time become Python strings. `raw` embeds
    the text as it is (queries) instead of prefixed (chunks). Of a chunk `max_chars` are read, as much as the
    default model takes in; hashes cover all of it.
    """
    return chunks.withColumn("embedding", _embedder(make_model, batch)(_model_text(raw, max_chars)))


def _model_text(raw: bool = False, max_chars: int | None = K.EMBED_MAX_CHARS) -> Column:
    return F.col("text") if raw else T.embed_text(F.col("repo"), F.col("path"), F.col("text"), max_chars)


def _embedder(make_model: Callable[[], Embedder], batch: int, known: bool = False):
    """Column function from texts to vectors; with `known`, null texts stand for known vectors: they do not reach
    the model and stay null."""
    def vectors(model, texts):
        rows = [_vectors(model(texts.slice(i, batch).to_pylist())) for i in range(0, len(texts), batch)]
        return pa.concat_arrays(rows) if rows else pa.array([], _VECTORS)

    @F.arrow_udf("array<float>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make_model()
        for part in texts:
            if not known:
                yield vectors(model, part)
                continue
            new = part.is_valid().to_numpy(zero_copy_only=False)
            yield vectors(model, part.drop_null()).take(pa.array(np.cumsum(new) - 1, pa.int64(), mask=~new))

    return run


def embed_missing(chunks: DataFrame, cache: DataFrame | None,
                  make_model: Callable[[], Embedder], batch: int = 8) -> DataFrame:
    """Vectors from the cache where known, from the model otherwise: one pass over the chunks, in which the model
    is given only the texts without a vector."""
    if cache is None:
        return embed(chunks, make_model, batch)
    split = split_by_cache(chunks, cache).drop("hash")
    asked = F.when(F.col("embedding").isNull(), _model_text())
    return split.withColumn("embedding", F.coalesce("embedding", _embedder(make_model, batch, known=True)(asked)))


def fastembed_model(name: str = MODEL_NAME) -> Callable[[], Embedder]:
    """Factory of the default model; needs the optional package on the workers."""
    def make() -> Embedder:
        try:
            from fastembed import TextEmbedding
        except ImportError as e:
            raise RuntimeError("the default embedding model is not installed here") from e
        model = TextEmbedding(name)
        return lambda texts: np.stack(list(model.embed(texts)))
    return make
