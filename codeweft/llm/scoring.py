"""N-gram language model as a weighted backoff automaton, trained and applied on the corpus.

States are contexts (the last n - 1 tokens at most) that training has seen; the arcs of a state
are the n-grams that continue it. With Dirichlet smoothing

    P(w | h) = (c(hw) + m * P(w | h')) / (c(h) + m),      h' = h without its first token,

an arc weighs log10 P(w | h) and the failure arc from h to h' weighs log10(m / (c(h) + m)), which
is what remains when c(hw) is 0; the root holds P(w) = (c(w) + 1) / (N + V + 1). Each level sums
to 1 over the V known words and one unknown, so scores are log probabilities.

A traversal needs only the counts of the grams and contexts on its way. So a chunk of documents
(chunks.py) sends each distinct gram once, with how often its training texts have it; buckets
return corpus counts in the order of the question. From them the chunk builds the part of the
automaton that its texts can reach and traverses it (automaton.py). The model is never whole in one
place and grows with the corpus."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .automaton import build, traverse
from .chunks import bucket_runs, dealt, runs, unpack
from .words import Words, mix, words_of

END, START = np.uint64(0xE2D), np.uint64(0x57A27)       # tokens that no word hash is expected to meet
_NEXT = np.uint64(0x9FB21C651E98DF25)
_REQUEST = "bucket bigint, chunk bigint, grams binary, counts binary"
_ANSWER = "chunk bigint, bucket bigint, counts binary"


def with_ends(words: Words) -> Words:
    """The words of each text and one END."""
    n = len(words.counts)
    at = words.offsets[1:] + np.arange(n)
    out = np.zeros(len(words.hashes) + n, np.uint64)
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[at], out[keep] = END, words.hashes
    return Words(out, words.offsets + np.arange(n + 1))


def gram_levels(tokens: Words, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each token, for n = 1 to `order`. Level 2 of a text's first
    token starts with START; higher levels that would begin before START repeat the level below."""
    first = np.zeros(len(tokens.hashes), bool)
    first[tokens.offsets[:-1]] = True
    levels = [tokens.hashes]
    for _ in range(order - 1):
        before = np.concatenate(([START], levels[-1][:-1]))
        before[first] = START if len(levels) == 1 else 0
        level = mix(before * _NEXT + tokens.hashes + np.uint64(len(levels)))
        if len(levels) > 1:
            shallow = first.copy()
            for d in range(1, len(levels) - 1):
                shallow[d:] |= first[:-d]
            level[shallow] = levels[-1][shallow]
        levels.append(level)
    return levels


def _pack(grams: np.ndarray) -> bytes:
    """The low 48 bits of each hash. Together with the bucket, which all 64 bits choose and which holds
    a bounded number of grams, they tell grams apart but for one in 10**8 or so."""
    return np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(column) -> tuple[np.ndarray, np.ndarray]:
    raw, row = unpack(column, np.dtype("V6"))
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = np.frombuffer(raw.tobytes(), np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1), row


def planes(counts: np.ndarray) -> bytes:
    """64-bit counts byte plane by byte plane: mostly zeros in a row, which shuffles compress away."""
    return np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def _distinct(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (bucket, gram) without repeats, and the place of each input in them."""
    values, place = np.unique(grams, return_inverse=True)
    bucket = (mix(values) >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((values, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], bucket[order].astype(np.int64), rank[place]


def _chunk_grams(table, order: int, buckets: int):
    """Tokens of a chunk, its distinct grams of all levels (START too), and the grams at each token."""
    tokens = with_ends(words_of(table.column("text"), lower=True))
    levels = gram_levels(tokens, order)
    grams, bucket, place = _distinct(np.concatenate([*levels, [START]]), buckets)
    at = place[:-1].reshape(order, -1)
    return tokens, levels, grams, bucket, at, place[-1]


def _train_counts(table, tokens, levels, grams, at, start_at) -> np.ndarray:
    taught = ~table.column("held_out").to_numpy()
    mask = np.repeat(taught, tokens.counts)
    counts = np.bincount(at[0][mask], minlength=len(grams))
    for level in range(1, len(levels)):
        new = mask & (levels[level] != levels[level - 1])
        counts += np.bincount(at[level][new], minlength=len(grams))
    counts[start_at] = taught.sum()
    return counts


def vocabulary(docs: DataFrame, buckets: int) -> tuple[int, int]:
    """(tokens, distinct tokens) of the rows not held out. Distinct tokens of each Arrow batch go to
    hash buckets, so the driver gets two numbers."""
    def local(batches):
        for batch in batches:
            tokens = with_ends(words_of(batch.column("text"), lower=True))
            taught = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False), tokens.counts)
            values, bucket, _ = _distinct(tokens.hashes[taught], buckets)
            out = bucket_runs(bucket)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([b for b, _ in out] + [-1], pa.int64()),
                "grams": pa.array([_pack(values[s]) for _, s in out] + [None], pa.binary()),
                "n": pa.array([0] * len(out) + [int(taught.sum())], pa.int64())})

    def count(table: pa.Table) -> pa.Table:
        values, _ = _unpack(table.column("grams").drop_null())
        return pa.table({"n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                         "v": pa.array([len(np.unique(values))], pa.int64())})

    sent = docs.select("text", "held_out").mapInArrow(local, "bucket bigint, grams binary, n bigint")
    types = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(count, "n bigint, v bigint")
    row = types.unionByName(sent.where("bucket < 0").agg(F.sum("n").alias("n")).select("n", F.lit(0).cast("long").alias("v"))
                            ).agg(F.sum("n"), F.sum("v")).head()
    return row[0] or 0, row[1] or 0


def score(docs: DataFrame, order: int = 2, prior: float = 200.0, chunk_bytes: int | None = None,
          bucket_bytes: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`
    (doc_id, text, held_out boolean), learning from the rows not held out.

    Tokens are words with A-Z folded, then one end. Null and empty texts have the end alone. Scores
    are log10; base_score is the root's add-one model, score the automaton's of the given order.
    `prior` is m. Repeated rows count and score each for themselves; other columns are not read;
    an empty table gives no rows. With nothing to learn from every count is 0."""
    sizes = {k: v for k, v in (("chunk_bytes", chunk_bytes), ("bucket_bytes", bucket_bytes)) if v}
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    docs, buckets = dealt(docs, **sizes)
    n, v = vocabulary(docs, buckets)

    def ask(key, table):
        tokens, levels, grams, bucket, at, start_at = _chunk_grams(table, order, buckets)
        counts = _train_counts(table, tokens, levels, grams, at, start_at)
        out = bucket_runs(bucket)
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(out), pa.int64()),
                         "grams": pa.array([_pack(grams[s]) for _, s in out], pa.binary()),
                         "counts": pa.array([planes(counts[s]) for _, s in out], pa.binary())})

    def add_up(key, table):
        grams, row = _unpack(table.column("grams"))
        counts = np.concatenate([from_planes(x.as_buffer()) for x in table.column("counts")])
        order_ = np.argsort(grams, kind="stable")
        at = runs(grams[order_])
        totals = np.zeros(len(grams), np.int64)
        if len(at):
            totals[order_] = np.repeat(np.add.reduceat(counts[order_].astype(np.int64), at), np.diff(np.append(at, len(grams))))
        return pa.table({"chunk": table.column("chunk"), "bucket": pa.array([key[0].as_py()] * table.num_rows, pa.int64()),
                         "counts": pa.array([planes(totals[s]) for _, s in bucket_runs(row)], pa.binary())})

    def walk(key, table, answers):
        tokens, levels, grams, _, at, start_at = _chunk_grams(table, order, buckets)
        answers = answers.sort_by("bucket")
        counts = np.concatenate([from_planes(x.as_buffer()) for x in answers.column("counts")]).astype(np.float64)
        first = np.zeros(len(tokens.hashes), bool)
        first[tokens.offsets[:-1]] = True
        known = counts[at[0]]
        base = np.log10((known + 1) / (n + v + 1))
        deeper = [np.ones(len(first), bool)] + [a != b for a, b in zip(levels[1:], levels)]
        model = build(at, deeper, first, counts, start_at, n, v, prior)
        ends = tokens.offsets[:-1]
        total = lambda x: np.add.reduceat(x, ends) if len(ends) else np.zeros(0)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(tokens.counts, pa.int64()),
            "n_known": pa.array(total((known > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([n] * table.num_rows, pa.int64()),
            "base_score": pa.array(total(base), pa.float64()), "score": pa.array(traverse(model, at[0], tokens.offsets), pa.float64())})

    chunks = docs.groupBy("chunk")
    counted = chunks.applyInArrow(ask, _REQUEST).groupBy("bucket").applyInArrow(add_up, _ANSWER)
    return chunks.cogroup(counted.groupBy("chunk")).applyInArrow(
        walk, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op9(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held.alias("held_out")))
