"""Near-duplicate code across repositories: best foreign match per chunk, then file pairs."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..constants import SIM_THRESHOLD
from ..functions import text as T
from ..functions.vectors import arrow_schema, as_matrix, batch_of, normalised
from ..session import cut
from .knn import blocks_for, pieces

# Similarities are rounded once, where they are made; equal ones are settled by the smaller id.
_PLACES = 9
# Bytes of float64 vectors per side of one pair of blocks, and of those that every task holds.
CELL_BYTES = 16 << 20
# Similarities held at once by one task.
_TILE = 1 << 20
# Vectors that pivots are chosen from, and pivots at most.
PIVOT_SAMPLE, MAX_PIVOTS = 20_000, 4096


def analysis_set(chunks: DataFrame, min_len: int = 0) -> DataFrame:
    """Named code chunks of `min_len` characters or more; texts are measured, never carried."""
    length = F.length("text") if "text" in chunks.columns else F.col("text_len")
    return chunks.where(T.analysable(F.col("repo"), F.col("path"), F.col("lang"),
                                     F.col("symbol"), length, min_len)) \
                 .select("id", "repo", "path", "start_line", "symbol", "embedding")


def _best(ids_a, repo_a, a, ids_b, repo_b, b, threshold):
    """Per row of a: the most similar row of b from another repo, if it reaches threshold.

    Rows of b ascend by id, so the first column of the greatest (rounded) similarity has the smallest id.
    """
    out, step = ([], [], []), max(1, _TILE // max(len(b), 1))
    for s in range(0, len(a), step):
        sims = np.round(a[s:s + step] @ b.T, _PLACES)
        sims[repo_a[s:s + step, None] == repo_b[None, :]] = -2.0
        col = sims.argmax(axis=1)
        top = sims[np.arange(len(col)), col]
        keep = np.nonzero((top > -1.5) & (top >= threshold))[0]
        out[0].append(ids_a[s + keep])
        out[1].append(ids_b[col[keep]])
        out[2].append(top[keep])
    return [np.concatenate(x) if x else np.empty(0) for x in out]


def _block(table):
    def col(name):
        return table.column(table.schema.get_field_index(name))

    ids = np.asarray(col("id"))
    order = np.argsort(ids, kind="stable")
    return ids[order], np.asarray(col("repo_key"))[order], normalised(as_matrix(col("embedding")))[order]


def _keyed(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.xxhash64("repo").alias("repo_key"), "embedding").where("embedding IS NOT NULL")


def _row_bytes(vectors: DataFrame) -> tuple[int, int]:
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    return size["n"], 8 * max(size["d"] or 1, 1)


def _folded(found: DataFrame) -> DataFrame:
    """The best of several partial answers, combined before the shuffle."""
    return found.groupBy("id").agg(F.min_by("best_id", F.struct(-F.col("sim"), "best_id")).alias("best_id"),
                                   F.max("sim").alias("sim"))


def best_foreign(vectors: DataFrame, threshold: float = -1.0, **kw) -> DataFrame:
    """vectors(id, repo, embedding) -> (id, best_id, sim), one row per chunk with a match."""
    return best_match(vectors, vectors, threshold, **kw)


def best_match(left: DataFrame, right: DataFrame, threshold: float = -1.0,
               broadcast_bytes: int = CELL_BYTES, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(id, best_id, sim) for rows of `left` with a row of `right` from another repo that reaches the
    threshold: the most similar one, of equals (to nine places) the one of smaller id.

    A task holds two blocks of CELL_BYTES at most. While `right` is one such block it is multiplied
    against each partition of `left` in place. Beyond that both are dealt into blocks and `Pruned`
    leaves out pairs of blocks that can't hold a better match.
    """
    l, r = _keyed(left), _keyed(right)  # noqa: E741
    n, row_bytes = _row_bytes(r)
    id_type = l.schema["id"].dataType.simpleString()
    fields = f"id {id_type}, best_id {id_type}, sim double"
    result = arrow_schema(fields)
    if not n:
        return l.sparkSession.createDataFrame([], fields)
    if n * row_bytes > broadcast_bytes:
        return Pruned(l, r, n, row_bytes, threshold, fields, cell_bytes).answer()
    held = l.sparkSession.sparkContext.broadcast(_block(r.toArrow()))

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch_of(_best(*_block(batch), *held.value, threshold), result)

    # every chunk is seen by exactly one task against everything: already final
    spread = l.repartition(max(1, min(l.sparkSession.sparkContext.defaultParallelism, n // 500)))
    return spread.mapInArrow(scan, fields)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector that is farthest from those before it."""
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


class Pruned:
    """Best matches by blocks around pivots.

    Every vector lies in the cell of its nearest pivot; a cell of many vectors is several blocks of
    bounded size, by hash of the id, so a thousand copies of one vector spread. First each row of
    `left` meets the blocks of its own cell, which gives a similarity that its answer has at least. By
    the triangle inequality a cell can hold a better one only if the row's distance to its pivot, less
    the cell's radius, is within the distance of that similarity. Only such pairs of blocks are made,
    each one task of bounded size that gives one row per vector. Pivots come from PIVOT_SAMPLE vectors
    by hash of the id; they decide how much is skipped, never the answer.

    The driver holds the pivots with radius and count of their cells, MAX_PIVOTS at most."""

    def __init__(self, left, right, n, row_bytes, threshold, fields, cell_bytes):
        self.threshold, self.fields, self.row_bytes = threshold, fields, row_bytes
        self.cells = min(MAX_PIVOTS, max(2, 2 * blocks_for(n, row_bytes, cell_bytes)))
        rows = right.orderBy(F.xxhash64("id"), "id").select("embedding").limit(max(self.cells, min(
            PIVOT_SAMPLE, (64 << 20) // row_bytes))).toArrow()
        self.pivots = choose_pivots(normalised(as_matrix(rows.column("embedding"))), self.cells)
        self._step = max(1, _TILE // len(self.pivots))
        self.right = cut(self._placed(right))
        self.left = cut(self._placed(left))
        stats = self.right.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect()
        self.radius, self.parts = np.full(len(self.pivots), -np.inf), np.ones(len(self.pivots), np.int64)
        for row in stats:
            self.radius[row.cell], self.parts[row.cell] = row.r, blocks_for(row.n, row_bytes, cell_bytes)
        self.left_parts = np.zeros(len(self.pivots), np.int64)
        for row in self.left.groupBy("cell").count().collect():
            self.left_parts[row["cell"]] = blocks_for(row["count"], row_bytes, cell_bytes)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """`rows` with the cell of the nearest pivot and the distance to it."""
        kind = rows.schema["id"].dataType.simpleString()
        fields = f"id {kind}, repo_key bigint, embedding array<float>, cell int, away double"
        result, pivots, step = arrow_schema(fields), self.pivots, self._step

        def place(batches):
            for batch in (p for b in batches for p in pieces(b, step)):
                if batch.num_rows:
                    far = _distances(normalised(as_matrix(batch.column("embedding"))), pivots)
                    cell = far.argmin(axis=1)
                    yield batch_of([batch.column("id"), batch.column("repo_key"), batch.column("embedding"),
                                    cell, far[np.arange(len(cell)), cell]], result)

        return rows.mapInArrow(place, fields)

    def _meet(self, asked: DataFrame) -> DataFrame:
        """asked(id, repo_key, embedding, home, cells array<int>), with the cell that a row itself is in,
        against all blocks of those cells."""
        threshold, result = self.threshold, arrow_schema(self.fields)
        listed = lambda values: F.array(*[F.lit(int(p)) for p in values])
        parts = listed(self.parts)
        asked = (asked.select("id", "repo_key", "embedding", "home", F.explode("cells").alias("cell"))
                 .withColumn("part", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("cell")) - 1)))
                 .withColumn("mine", F.pmod(F.xxhash64("id"), F.get(listed(self.left_parts), F.col("home"))).cast("int")))
        pairs = cut(asked.select("cell", "part", "home", "mine").distinct())
        self.pairs_met += pairs.count()
        held = self.right.withColumn("part", F.pmod(F.xxhash64("id"), F.get(parts, F.col("cell"))).cast("int")) \
            .select("id", "repo_key", "embedding", "cell", "part").join(pairs, ["cell", "part"])
        key = ["cell", "part", "home", "mine"]

        def task(one, other):
            if not one.num_rows or not other.num_rows:
                return pa.Table.from_batches([], schema=result)
            return pa.Table.from_batches([batch_of(_best(*_block(one), *_block(other), threshold), result)])

        return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(task, self.fields)

    pairs_met = 0

    def all_pairs(self) -> int:
        """Pairs of blocks without pruning."""
        return int(self.parts[self.radius >= 0].sum() * self.left_parts.sum())

    def answer(self) -> DataFrame:
        live = self.radius >= 0
        own = self.left.where(F.get(F.array(*[F.lit(bool(x)) for x in live]), F.col("cell")))
        near = cut(_folded(self._meet(own.withColumn("home", F.col("cell")).withColumn("cells", F.array("cell")))))
        kind = self.left.schema["id"].dataType.simpleString()
        fields = f"id {kind}, repo_key bigint, embedding array<float>, home int, cells array<int>"
        result, pivots, radius, floor_, step = arrow_schema(fields), self.pivots, self.radius, self.threshold, self._step

        def needed(batches):
            for batch in (p for b in batches for p in pieces(b, step)):
                sim = np.maximum(np.nan_to_num(np.asarray(batch.column("sim"), dtype=np.float64), nan=-1.0), floor_)
                # normalised vectors are no longer than one, so this is no less than their distance
                reach = np.sqrt(np.maximum(2 - 2 * np.maximum(sim, -1.0), 0) + 1e-8)
                far = _distances(normalised(as_matrix(batch.column("embedding"))), pivots)
                want = live & (far - radius <= reach[:, None])
                want[np.arange(len(want)), np.asarray(batch.column("cell"))] = False
                yield batch_of([batch.column("id"), batch.column("repo_key"), batch.column("embedding"),
                                batch.column("cell"), [np.flatnonzero(w) for w in want]], result)

        rest = self.left.join(near.select("id", "sim"), "id", "left").mapInArrow(needed, fields)
        return _folded(near.unionByName(self._meet(cut(rest.where(F.size("cells") > 0)))))


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1) - 2.0 * (rows @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def refreshed_best(best: DataFrame, old: DataFrame, removed: DataFrame, added: DataFrame, threshold: float = -1.0,
                   **kw) -> DataFrame:
    """Best matches after a change, from those before it: `removed` has the ids that are gone or
    changed, `added` the new rows (id, repo, embedding).

    New chunks meet all; old ones whose partner is gone meet all again; all others keep their partner
    unless a new chunk is closer. Work grows with the change, not with the square of the whole."""
    gone = cut(removed.select("id").distinct())
    kept = old.join(gone, "id", "left_anti")
    now = kept.select("id", "repo", "embedding").unionByName(added.select("id", "repo", "embedding"))
    known = best.join(gone, "id", "left_anti")
    orphans = cut(known.join(gone.withColumnRenamed("id", "best_id"), "best_id", "left_semi").select("id"))
    again = cut(kept.join(orphans, "id", "left_semi").select("id", "repo", "embedding")
                .unionByName(added.select("id", "repo", "embedding")))
    steady = kept.join(orphans, "id", "left_anti")
    found = [known.join(orphans, "id", "left_anti").select("id", "best_id", "sim").where(F.col("sim") >= threshold),
             best_match(again, now, threshold, **kw), best_match(steady, added, threshold, **kw)]
    return _folded(found[0].unionByName(found[1]).unionByName(found[2]))


def find_pairs(analysed: DataFrame, threshold: float = SIM_THRESHOLD, **kw) -> DataFrame:
    """Ledger rows (a, b, n, max_sim, example) of cross-repo file pairs.

    n counts directed hits. `example` is the symbol of the most similar hit (smallest id on a
    tie), or its partner's where it has none.
    """
    return pairs_of(best_foreign(analysed, threshold, **kw), analysed)


def pairs_of(best: DataFrame, analysed: DataFrame) -> DataFrame:
    """The ledger of given best matches."""
    me = analysed.select("id", T.file_key(F.col("repo"), F.col("path")).alias("f"),
                         F.col("symbol").alias("s"))
    other = me.select(F.col("id").alias("best_id"), F.col("f").alias("of"), F.col("s").alias("os"))
    directed = best.join(me, "id").join(other, "best_id").select(
        F.least("f", "of").alias("a"), F.greatest("f", "of").alias("b"), "sim", "id",
        F.coalesce(F.nullif("s", F.lit("")), "os").alias("shown"))
    return directed.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.round(F.max("sim"), 3).alias("max_sim"),
        F.min_by("shown", F.struct(-F.col("sim"), "id")).alias("example"))


def in_report_order(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("n"), F.desc("max_sim"), "a", "b")


def new_pairs(pairs: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Pairs the baseline does not hold; without a baseline nothing counts as new."""
    if baseline is None:
        return pairs.where(F.lit(False))
    return pairs.join(baseline.select("a", "b").distinct(), ["a", "b"], "left_anti") \
                .select(*pairs.columns)


def both_directions(ledger: DataFrame) -> DataFrame:
    """file, other, n, max_sim for either end of every pair."""
    return ledger.select(F.explode(F.array(
        F.struct(F.col("a").alias("file"), F.col("b").alias("other"), "n", "max_sim"),
        F.struct(F.col("b").alias("file"), F.col("a").alias("other"), "n", "max_sim"))).alias("e")) \
        .select("e.*")


def lookup(ledger: DataFrame, repo: str, path: str) -> DataFrame:
    """Known duplicates of one file."""
    return both_directions(ledger).where(F.col("file") == f"{repo}/{path}")
