"""Documents dealt into chunks, and values dealt into buckets, for work that asks "who else has
this hash?" about every word of a corpus.

A chunk is a hash class of doc_id with about CHUNK_BYTES of text; a bucket is a hash class of
values with about as many values as BUCKET_BYTES of text have words. Chunks send each bucket one
packed row of distinct values, buckets answer chunks with packed rows. Their numbers grow with
the corpus, so neither grows itself; and as a chunk sends each value once, a value that a third
of all documents hold is one entry per chunk."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20


def dealt(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """`docs` plus `chunk`, and the number of buckets that their texts call for. Rows without doc_id are
    dealt by their text."""
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.withColumn("chunk", F.pmod(key, F.lit(chunks))), max(1, -(-total // bucket_bytes))


def by_doc_id(table: pa.Table) -> pa.Table:
    """Rows by doc_id, null last."""
    return table.sort_by([("doc_id", "ascending")])


def bucket_runs(buckets: np.ndarray) -> list[tuple[int, slice]]:
    """(bucket, slice) of each run of a sorted array."""
    if not len(buckets):
        return []
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(buckets)]))
    return [(int(buckets[s]), slice(s, e)) for s, e in zip(starts, ends)]


def unpack(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed rows, and the row that each came from."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column]
    sizes = [len(p) for p in parts]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.repeat(np.arange(len(parts)), sizes)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1))
