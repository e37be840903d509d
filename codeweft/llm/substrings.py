"""Exact repeats of word sequences between documents, found by fixed-block anchors.

A repeat of `window` words holds a whole block of (window + 1) / 2 words wherever blocks are laid,
so the index has one entry for each non-overlapping block of every text, and every rolling window
of block length probes it. A hit is an anchor. Around anchors, windows of full length are compared
by their hashes, and runs of equal windows are the maximal exact repeats.

Probes are packed per chunk (chunks.py): the only large shuffle holds four bytes for each distinct
rolling window of a chunk. 30 hash bits within a bucket meet by chance now and then; that makes
an idle anchor, as full windows are compared by 64 bits.

Both questions are answered per value, never per pair of documents: a passage in a third of all
documents is one entry per chunk."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import bucket_runs, by_doc_id, dealt, runs, unpack
from .words import Words, grams, words_of

_LOW = np.uint64((1 << 30) - 1)
_ALIGNED, _SHARED = np.uint32(2), np.uint32(1)
_REQUEST = "bucket bigint, chunk bigint, payload binary, ids binary"
_ANSWER = "chunk bigint, bucket bigint, kind int, payload binary"
_NULL_ID = np.iinfo(np.int64).max     # a null doc_id counts as the greatest


def _rows(columns: dict, schema: str) -> pa.Table:
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array(columns[n], types[t]) for n, t in fields})


class _Probes:
    """Rolling block-length windows of one chunk: where they start, their bucket and 30-bit code."""

    def __init__(self, words: Words, window: int, buckets: int):
        self.block = (window + 1) // 2
        start, h = grams(words, self.block)
        long = (words.counts >= window)[words.text_of_word()[start]] if len(start) else np.zeros(0, bool)
        self.start, h = start[long], h[long]
        self.text = words.text_of_word()[self.start] if len(self.start) else self.start
        self.aligned = (self.start - words.offsets[self.text]) % self.block == 0
        self.bucket = (h >> np.uint64(32)) % np.uint64(buckets)
        self.code = (self.bucket << np.uint64(30)) | (h & _LOW)

    def distinct(self):
        """Sorted distinct codes; whether one is a block, and whether several texts have it."""
        order = np.argsort(self.code, kind="stable")
        code, text = self.code[order], self.text[order]
        at = runs(code)
        if not len(at):
            return code, np.zeros(0, bool), np.zeros(0, bool)
        last = np.append(at[1:], len(code)) - 1
        return code[at], np.logical_or.reduceat(self.aligned[order], at), text[at] != text[last]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(_NULL_ID).to_numpy()


def _covered(table: pa.Table, answers: pa.Table, window: int, buckets: int):
    """Windows of full length around anchors: (words, start, hash, id), ordered by text."""
    words = words_of(table.column("text"))
    probes = _Probes(words, window, buckets)
    mine = answers.filter(pa.compute.equal(answers["kind"], 1))
    hits = [(np.uint64(b) << np.uint64(30)) | np.frombuffer(p.as_buffer(), np.uint32).astype(np.uint64)
            for b, p in zip(mine["bucket"].to_numpy(), mine["payload"])]
    code, aligned, shared = probes.distinct()
    known = np.unique(np.concatenate([code[aligned & shared], *hits]))
    anchor = np.zeros(len(words.hashes) + 1, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, probes.code), len(known) - 1)
        anchor[probes.start[known[at] == probes.code] + 1] = 1
    before = np.cumsum(anchor)                    # anchors that start before a word
    start, h = grams(words, window)
    near = before[np.minimum(start + window - probes.block + 1, len(words.hashes))] > before[start]
    start, h = start[near], h[near]
    return words, start, h, _ids(table)[words.text_of_word()[start]] if len(start) else np.zeros(0, np.int64)


def _least(h: np.ndarray, ids: np.ndarray):
    """Sorted distinct hashes and the least id of each."""
    order = np.lexsort((ids, h))
    at = runs(h[order])
    return h[order][at], ids[order][at]


def repeats(docs: DataFrame, window: int = 13, chunk_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) for each row of `docs` (doc_id, text).

    `spans` are the maximal runs of words [start, end) inside windows of `window` words that also
    start in a document of smaller doc_id; `kept` is the text of all other words, one space apart.
    Null and empty texts have no words and kept "". Texts shorter than a window stay as they are.
    Rows that repeat a doc_id don't count as smaller than each other. A null doc_id counts as the
    greatest. Other columns are not read; an empty table gives no rows."""
    sizes = {k: v for k, v in (("chunk_bytes", chunk_bytes), ("bucket_bytes", bucket_bytes)) if v}
    kind = dict(docs.dtypes)["doc_id"]
    docs, buckets = dealt(docs.select("doc_id", "text"), **sizes)

    def probe(key, table):
        code, aligned, shared = _Probes(words_of(table.column("text")), window, buckets).distinct()
        packed = ((code & _LOW).astype(np.uint32) << np.uint32(2)) | (aligned * _ALIGNED) | (shared * _SHARED)
        out = bucket_runs((code >> np.uint64(30)).astype(np.int64))
        return _rows({"bucket": [b for b, _ in out], "chunk": [key[0].as_py()] * len(out),
                      "payload": [packed[s].tobytes() for _, s in out], "ids": [None] * len(out)}, _REQUEST)

    def index(key, table):
        """Codes that several chunks sent, at least one of them as a block."""
        packed, row = unpack(table.column("payload"), np.uint32)
        order = np.argsort(packed >> np.uint32(2), kind="stable")
        code, row = (packed >> np.uint32(2))[order], row[order]
        at = runs(code)
        if len(at):
            last = np.append(at[1:], len(code)) - 1
            good = (row[at] != row[last]) & np.logical_or.reduceat((packed[order] & _ALIGNED) > 0, at)
            hit = np.repeat(good, np.diff(np.append(at, len(code))))
            code, row = code[hit], row[hit]
            order = np.argsort(row, kind="stable")
            code, row = code[order], row[order]
        chunk = table.column("chunk").to_numpy()
        out = bucket_runs(row)
        return _rows({"chunk": [int(chunk[r]) for r, _ in out], "bucket": [key[0].as_py()] * len(out), "kind": [1] * len(out),
                      "payload": [code[s].tobytes() for _, s in out]}, _ANSWER)

    def ask(key, table, answers):
        _, _, h, ids = _covered(by_doc_id(table), answers, window, buckets)
        h, ids = _least(h, ids)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, ids = h[order], ids[order]
        out = bucket_runs(bucket[order])
        return _rows({"bucket": [b for b, _ in out], "chunk": [key[0].as_py()] * len(out), "payload": [h[s].tobytes() for _, s in out],
                      "ids": [ids[s].tobytes() for _, s in out]}, _REQUEST)

    def decide(key, table):
        """For each chunk the windows that start in a smaller document elsewhere."""
        h, row = unpack(table.column("payload"), np.uint64)
        ids, _ = unpack(table.column("ids"), np.int64)
        least_h, least_id = _least(h, ids)
        smaller = ids > least_id[np.searchsorted(least_h, h)] if len(h) else np.zeros(0, bool)
        h, row = h[smaller], row[smaller]
        chunk = table.column("chunk").to_numpy()
        out = bucket_runs(row)
        return _rows({"chunk": [int(chunk[r]) for r, _ in out], "bucket": [key[0].as_py()] * len(out), "kind": [2] * len(out),
                      "payload": [h[s].tobytes() for _, s in out]}, _ANSWER)

    def finish(key, table, answers):
        table = by_doc_id(table)
        words, start, h, ids = _covered(table, answers, window, buckets)
        mine, _ = unpack(answers.filter(pa.compute.equal(answers["kind"], 2)).column("payload"), np.uint64)
        least_h, least_id = _least(h, ids)
        gone = np.isin(h, mine)
        if len(h):
            gone |= ids > least_id[np.searchsorted(least_h, h)]
        edge = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(edge, start[gone], 1)
        np.add.at(edge, start[gone] + window, -1)
        cover = np.cumsum(edge)[:-1] > 0
        removed, spans, kept = [], [], []
        for i, text in enumerate(table.column("text")):
            part = cover[words.offsets[i]:words.offsets[i + 1]]
            all_words = (text.as_py() or "").encode().split()      # bytes split at ASCII white space
            if part.any():
                steps = np.flatnonzero(np.diff(np.concatenate(([0], part.view(np.int8), [0]))))
                spans.append([{"start": int(a), "end": int(b)} for a, b in steps.reshape(-1, 2)])
                all_words = [w for w, c in zip(all_words, part) if not c]
            else:
                spans.append([])
            removed.append(int(part.sum()))
            kept.append(b" ".join(all_words).decode())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept": pa.array(kept, pa.string())})

    chunks = docs.groupBy("chunk")
    anchors = chunks.applyInArrow(probe, _REQUEST).groupBy("bucket").applyInArrow(index, _ANSWER)
    windows = (chunks.cogroup(anchors.groupBy("chunk")).applyInArrow(ask, _REQUEST)
               .groupBy("bucket").applyInArrow(decide, _ANSWER))
    return chunks.cogroup(anchors.unionAll(windows).groupBy("chunk")).applyInArrow(
        finish, f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string")


def op3(spark, sf_dir: str) -> DataFrame:
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"),
                        F.size("spans").cast("long").alias("n_spans"))
