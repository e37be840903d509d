"""Exact nearest neighbours: one query, many queries, and the search built on them."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T
from ..functions.vectors import (arrow_schema, as_matrix, batch_of, cos_from_distance,
                                 l2_distance)

# Bytes of queries, vectors and best rows, that one task holds.
HELD_BYTES = 32 << 20
# Pairs of vectors from which on a few partitions are dealt to all cores.
_SPREAD_PAIRS = 1 << 26


def top_k(chunks: DataFrame, query, k: int = 20, id_col: str = "id",
          embedding: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, distance) of the k nearest rows; ties go to the smaller id.

    Only id, vector and the narrow columns named in `carry` are read. Wide ones are joined
    back to the result, which has k rows (`hits`).
    """
    return (chunks.select(id_col, *carry, l2_distance(F.col(embedding), query).alias("distance"))
            .where("distance IS NOT NULL").orderBy("distance", id_col).limit(k))


def hits(chunks: DataFrame, nearest: DataFrame, *columns: str, id_col: str = "id") -> DataFrame:
    """Chunk columns of an already limited (id, distance) frame."""
    return (chunks.select(id_col, *columns).join(F.broadcast(nearest), id_col)
            .withColumn("cos", cos_from_distance(F.col("distance"))))


def search(chunks: DataFrame, query, k: int = 20, id_col: str = "id") -> DataFrame:
    cols = ["repo", "path", "start_line", "end_line", "symbol", "lang",
            F.length("text").alias("text_len")]
    return hits(chunks, top_k(chunks, query, k, id_col), *cols, id_col=id_col) \
        .orderBy("distance", id_col)


def post_filtered(chunks: DataFrame, query, repo: str, k: int = 8,
                  carry: tuple[str, ...] = (), pool: int | None = None) -> DataFrame:
    """The k nearest of one repo. With `pool`, only those among the so many nearest overall, which may
    give fewer."""
    if pool is None:
        return pre_filtered(chunks, query, repo, k, carry)
    near = top_k(chunks, query, pool, carry=("repo", *carry))
    return near.where(F.col("repo") == repo).orderBy("distance", "id").limit(k)


def pre_filtered(chunks: DataFrame, query, repo: str, k: int = 8,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest of one repo: the filter reaches the scan, so it never under-fills."""
    return top_k(chunks.where(F.col("repo") == repo), query, k, carry=("repo", *carry))


# Distances held at once by one task.
_TILE = 1 << 20
# Rows per query and best row that a task keeps, with what their merging takes for a moment.
_KEPT_BYTES = 48


class Nearest:
    """The k nearest rows so far of a block of queries, while chunks pass in batches of any order; with
    repository keys `own`, only rows of other repositories than a query's own.

    A row enters only if it is no farther than the k-th so far, so after the first batches little is
    sorted. Equal (quantised) distances are settled by id.
    """

    def __init__(self, ids, rows, own, k):
        self.ids, self.rows, self.own, self.k = ids, rows, own, k
        self.norms = (rows * rows).sum(1)
        self.d2, self.found = np.full((len(rows), k), np.inf), None

    def add(self, ids, v, repo):
        if not len(self.ids) or not len(v):
            return
        if self.found is None:
            self.found = np.zeros(self.d2.shape, ids.dtype)
        norms, step = (v * v).sum(1), max(1, _TILE // len(v))
        for s in range(0, len(self.ids), step):
            here = slice(s, s + step)
            d2 = self.rows[here] @ v.T
            d2 *= -2.0
            d2 += norms
            d2 += self.norms[here, None]
            if self.own is not None:
                d2[self.own[here, None] == repo[None, :]] = np.inf
            edge = self.d2[here, -1]
            if self.k < len(v) and np.isinf(edge).any():
                edge = np.minimum(edge, np.partition(d2, self.k - 1, axis=1)[:, self.k - 1])
            # a margin above the quantum, which is met again below
            at, col = np.nonzero(d2 <= (np.maximum(edge, 0.0) + 1e-11)[:, None])
            near = np.round(np.maximum(d2[at, col], 0.0), 12)
            keep = np.flatnonzero((near <= self.d2[here, -1][at]) & (near < np.inf))
            if len(keep):
                self._merge(s + at[keep], near[keep], ids[col[keep]])

    def _merge(self, at, near, ids):
        rows = np.unique(at)
        owner = np.concatenate((np.repeat(rows, self.k), at))
        near = np.concatenate((self.d2[rows].ravel(), near))
        ids = np.concatenate((self.found[rows].ravel(), ids))
        order = np.lexsort((ids, near, owner))
        owner = owner[order]
        order = order[np.arange(len(order)) - np.searchsorted(owner, owner) < self.k]
        self.d2[rows], self.found[rows] = near[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)

    def batches(self, schema):
        """The answer as (query id, id, distance) rows, a part of the queries at a time."""
        step = max(1, _TILE // (8 * self.k))
        for s in range(0, len(self.ids) if self.found is not None else 0, step):
            at, col = np.nonzero(self.d2[s:s + step] < np.inf)
            yield batch_of((self.ids[s + at], self.found[s + at, col], np.sqrt(self.d2[s + at, col])), schema)


def pieces(batch, rows):
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _sorted_block(table, id_name, vec_name, key_name):
    """(ids, vectors, repository keys or None) of a batch, by id."""
    column = lambda name: table.column(table.schema.get_field_index(name))
    ids = np.asarray(column(id_name))
    rows = as_matrix(column(vec_name))
    order = np.argsort(ids, kind="stable")
    keys = np.asarray(column(key_name))[order] if key_name in table.schema.names else None
    return ids[order], (rows[order] if len(rows) else rows), keys


def best_k(found: DataFrame, k: int, tasks: int) -> DataFrame:
    """The k best of (qid, id, distance) rows as `rank` 0 to k - 1, merged in two levels: first those of
    about the root of all tasks together, then the k of each such group. Both are windows that Spark
    limits to k rows before it shuffles."""
    groups = max(1, round(tasks ** 0.5))
    order = ("distance", "id")
    if groups > 1:
        some = W.partitionBy("qid", "_group").orderBy(*order)
        found = (found.withColumn("_group", F.spark_partition_id() % groups)
                 .withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= k).drop("_n", "_group"))
    return (found.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy(*order)))
            .where(F.col("_n") <= k).withColumn("rank", F.col("_n") - 1).drop("_n"))


def batch_top_k(queries: DataFrame, chunks: DataFrame, k: int, qid: str = "qid",
                id_col: str = "id", broadcast_bytes: int = HELD_BYTES,
                cell_bytes: int = HELD_BYTES, foreign: bool = False) -> DataFrame:
    """(qid, id, distance, rank) for every query, nearest first; with `foreign`, only chunks whose
    `repo` is not the query's `own_repo` (told by 64-bit hashes; nulls are one repository).

    A task holds a block of queries with the k best of each, `cell_bytes` at most, while chunks stream
    past in batches: its memory depends on neither side's size. Queries that are one such block
    (`broadcast_bytes`) are held by every task and the chunks stay where they are; otherwise each block
    meets the chunks in as few parts as keep all cores busy. Either way a task gives at most k rows per
    query, and `best_k` merges those.
    """
    q = queries.select(F.col(qid).alias("qid"), F.col("embedding").alias("qv"),
                       *([F.xxhash64("own_repo").alias("own")] if foreign else []))
    c = chunks.select(F.col(id_col).alias("id"), F.col("embedding").alias("v"),
                      *([F.xxhash64("repo").alias("repo")] if foreign else [])).where("v IS NOT NULL")
    size = q.agg(F.count("*").alias("n"), F.max(F.size("qv")).alias("d")).first()
    if not size["n"]:
        size = {"n": 0, "d": 1}
    fields = f"qid {q.schema['qid'].dataType.simpleString()}, " \
             f"id {c.schema['id'].dataType.simpleString()}, distance double"
    row_bytes = 8 * max(size["d"] or 1, 1)
    held_bytes, n = row_bytes + k * _KEPT_BYTES, c.count()
    cores = q.sparkSession.sparkContext.defaultParallelism
    rows = max(1, cell_bytes // row_bytes)
    if size["n"] * held_bytes <= broadcast_bytes:
        tasks = c.rdd.getNumPartitions()
        if tasks < cores and size["n"] * n > _SPREAD_PAIRS:
            tasks, c = cores, c.repartition(cores)
        found = _against_broadcast(q, c, k, fields, rows)
    else:
        blocks = blocks_for(size["n"], held_bytes, cell_bytes)
        parts = max(1, min(-(-4 * cores // blocks), blocks_for(n, row_bytes, cell_bytes // 16)))
        found, tasks = _against_grid(q, c, k, fields, blocks, parts, rows), parts
    return best_k(found, k, tasks)


def _against_broadcast(q, c, k, fields, rows):
    table = q.toArrow()
    asked = _sorted_block(table, "qid", "qv", "own") if table.num_rows else (np.empty(0), np.empty((0, 0)), None)
    held = q.sparkSession.sparkContext.broadcast(asked)
    result = arrow_schema(fields)

    def scan(batches):
        best = Nearest(*held.value, k)
        for batch in batches:
            for piece in pieces(batch, rows):
                best.add(*_sorted_block(piece, "id", "v", "repo"))
        yield from best.batches(result)

    return c.mapInArrow(scan, fields)


def blocks_for(n: int, row_bytes: int, cell_bytes: int) -> int:
    return max(1, -(-n * row_bytes // max(cell_bytes, 1)))


def _against_grid(q, c, k, fields, blocks, parts, rows):
    """Every block of queries against every part of the chunks, each pair a task's stream: first the
    queries, which are held, then the chunks, which pass."""
    result = arrow_schema(fields)

    def dealt(col, total):
        return F.pmod(F.xxhash64(col), F.lit(total)).cast("int")

    def copies(total):
        return F.explode(F.sequence(F.lit(0), F.lit(total - 1)))

    qs = (q.withColumn("_part", copies(parts)).withColumn("cell", dealt("qid", blocks) * parts + F.col("_part"))
          .drop("_part").withColumn("passes", F.lit(False)))
    cs = (c.withColumn("_block", copies(blocks)).withColumn("cell", F.col("_block") * parts + dealt("id", parts))
          .drop("_block").withColumn("passes", F.lit(True)))
    stream = (qs.unionByName(cs, allowMissingColumns=True).repartition(blocks * parts, "cell")
              .sortWithinPartitions("cell", "passes"))

    def scan(batches):
        at, asked, best = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, passes = (np.asarray(batch.column(x)) for x in ("cell", "passes"))
            turns = np.flatnonzero((cell[1:] != cell[:-1]) | (passes[1:] != passes[:-1])) + 1
            for start, stop in zip([0, *turns], [*turns, len(cell)]):
                if cell[start] != at:
                    if best is not None:
                        yield from best.batches(result)
                    at, asked, best = cell[start], [], None
                part = batch.slice(start, stop - start)
                if not passes[start]:
                    asked.append(part)
                    continue
                if asked:
                    best = Nearest(*_sorted_block(pa.Table.from_batches(asked), "qid", "qv", "own"), k)
                    asked = []
                if best is not None:
                    for piece in pieces(part, rows):
                        best.add(*_sorted_block(piece, "id", "v", "repo"))
        if best is not None:
            yield from best.batches(result)

    return stream.mapInArrow(scan, fields)


def nearest_foreign(queries: DataFrame, chunks: DataFrame, threshold: float | None = None, **kw) -> DataFrame:
    """Best match outside the query's own repo, if there is one.

    queries(qid, own_repo, embedding). The kernel leaves out the own repository, so near copies in it
    hide nothing; only the one row per query that is found is joined to its columns.
    """
    best = batch_top_k(queries, chunks, 1, foreign=True, **kw).drop("rank") \
        .withColumn("cos", cos_from_distance(F.col("distance")))
    if threshold is not None:
        best = best.where(F.col("cos") >= threshold)
    meta = chunks.select("id", "repo", "path", "start_line", "end_line", "symbol")
    return best.join(queries.select("qid", "own_repo"), "qid").join(meta, "id")


def quantised(chunks: DataFrame, id_col: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, codes, scale, error): each vector in one signed byte a place, and how far at most that is
    from the vector itself. A table to be stored beside the chunks; rows without a vector have none."""
    kind = chunks.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, codes binary, scale double, error double"
    result = arrow_schema(fields)

    def pack(batches):
        for batch in batches:
            rows = as_matrix(batch.column(1))
            if not len(rows):
                continue
            scale = np.abs(rows).max(axis=1) / 127.0
            codes = np.rint(rows / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8)
            off = np.linalg.norm(rows - codes * scale[:, None], axis=1)
            # one part in 10**12 above it, for the rounding of later sums
            yield batch_of([batch.column(0), [c.tobytes() for c in codes], scale, off + 1e-12 * (1 + np.linalg.norm(rows, axis=1))], result)

    return chunks.where(F.col(embedding).isNotNull()).select(F.col(id_col).alias("id"), embedding).mapInArrow(pack, fields)


# Candidates up to this number go into the scan's filter, more of them into a join.
MAX_PUSHED = 1000


def bounded_top_k(chunks: DataFrame, codes: DataFrame, query, k: int = 20, embedding: str = "embedding",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """`top_k` by way of a `quantised` table: exact, but full vectors are read for candidates only.

    The k-th least upper bound on a distance limits the answer; rows whose lower bound is within it
    are the candidates, few more than k unless many distances are alike. Up to MAX_PUSHED of their
    ids are pushed into the scan of the chunks, so that files in the order of ids are skipped."""
    target = np.asarray(query, dtype=np.float64)

    @F.arrow_udf("struct<low double, high double>")
    def bounds(packed: pa.Array, scale: pa.Array, error: pa.Array) -> pa.Array:
        rows = np.frombuffer(b"".join(x.as_py() for x in packed), np.int8).reshape(len(packed), -1)
        near = np.linalg.norm(rows * scale.to_numpy()[:, None] - target, axis=1)
        off = error.to_numpy() + 1e-12 * (1 + near)
        return pa.StructArray.from_arrays([pa.array(np.maximum(near - off, 0.0)), pa.array(near + off)], names=["low", "high"])

    bounded = codes.select("id", bounds("codes", "scale", "error").alias("b")).select("id", "b.low", "b.high")
    limit = bounded.orderBy("high").limit(k).agg(F.max("high")).first()[0]
    if limit is None:
        return top_k(chunks.where("false"), query, k, embedding=embedding, carry=carry)
    near = bounded.where(F.col("low") <= limit).select("id")
    ids = [r[0] for r in near.limit(MAX_PUSHED + 1).collect()]
    some = (chunks.where(F.col("id").isin(ids)) if len(ids) <= MAX_PUSHED else chunks.join(near, "id", "left_semi"))
    return top_k(some, query, k, embedding=embedding, carry=carry)


def annotate_duplicates(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Limited search hits with the files known to duplicate theirs.

    ledger(file, other, n, max_sim) is only ever filtered by the few files of the hits.
    """
    keyed = found.withColumn("file", T.file_key(F.col("repo"), F.col("path")))
    known = ledger.join(F.broadcast(keyed.select("file").distinct()), "file", "left_semi")
    return keyed.join(known, "file", "left")


def semantic_search(chunks: DataFrame, query, k: int = 8, repo: str = "",
                    ledger: DataFrame | None = None) -> list[dict]:
    """Hits of one embedded query as dicts, nearest first; k rows reach the driver."""
    near = post_filtered(chunks, query, repo, k).drop("repo") if repo else top_k(chunks, query, k)
    found = hits(chunks, near, "repo", "path", "start_line", "end_line", "symbol", "lang",
                 T.snippet(F.col("text")).alias("snippet")).orderBy("distance", "id")
    rows = [r.asDict() for r in found.collect()]
    if ledger is not None and rows:
        files = {f"{r['repo']}/{r['path']}" for r in rows}
        known: dict = {}
        for d in ledger.where(F.col("file").isin(files)).orderBy("file", "other").collect():
            known.setdefault(d["file"], []).append(d)
        for r in rows:
            r["duplicates"] = known.get(f"{r['repo']}/{r['path']}")
    return rows
