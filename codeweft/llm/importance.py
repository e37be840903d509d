"""Target-distribution importance resampling: documents drawn as if from the distribution of a target table.

A 256-byte table lower-cases A-Z and blanks every ASCII byte that is no letter or digit, so that
`bytes.split` yields the words of a UTF-8 text; bytes above 0x7F are parts of words and stay. The
CRC-32 of a longer run of words goes on from that of the shorter one, so no run is ever joined, and
its residue is the feature's bucket. Counters reduce each text to its distinct features, each task to
one count per bucket, and a sum with partial aggregation to one row per bucket.

A bucket's gain is how much more often the target has it (log ratio, smoothed by one), a document's
weight the sum over its features. Weight plus Gumbel noise, fixed by a seed and the id, gives scores
whose highest are a draw without replacement in proportion to exp(weight)."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import global_rank
from ..session import cut
from .text import fresh

PIECE_BYTES = 1 << 20           # words are listed for so many bytes of a text at once
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece; pieces end where a word does."""
    blanked, at = text.translate(TABLE), 0
    while at < len(blanked):
        end = blanked.find(b" ", at + PIECE_BYTES)
        end = len(blanked) if end < 0 else end
        yield blanked[at:end].split()
        at = end


def features_of(text: bytes, n: int) -> tuple[int, Counter]:
    """Number of words, and how often the text has each feature, named by its CRC-32."""
    found, total, before = Counter(), 0, []
    for words in word_lists(text):
        total += len(words)
        if n == 1:
            for word, times in Counter(words).items():
                found[crc32(word)] += times
            continue
        for word in words:
            before = [crc32(word), *(crc32(word, crc32(b" ", seed)) for seed in before[:n - 1])]
            found.update(before)
    return total, found


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()))


def bucket_counts(texts: DataFrame, text: str, n: int, buckets: int) -> np.ndarray:
    """Occurrences of features in each bucket over all of `texts`. The driver gets `buckets` rows at most."""
    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for body in _bytes(batch.column(0)):
                for feature, times in features_of(body, n)[1].items():
                    sums[feature % buckets] += times
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], names=["bucket", "n"])

    rows = (texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row.bucket] = row.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 * log of the smoothed share in the target over that in the source), by bucket."""
    buckets, in_source, in_target = len(source), float(source.sum()), float(target.sum())
    return [floor(1000 * log((t + 1) * (in_source + buckets) / ((s + 1) * (in_target + buckets))))
            for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())]


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a keyed hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
          n: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """(`doc_id`, n_words, n_features, weight, score), all but the id long, for each row of `docs`.

    Features are runs of 1 to `n` words, repeats counted. Null and empty texts have no words, no
    features and weight 0; a null id draws the noise of an empty one. Repeated rows count and are
    weighed each for themselves; other columns are not read. An empty table gives no rows, an empty
    target gives weights from counts of 0. A text is held whole, its words a piece at a time."""
    kind = docs.schema[doc_id].dataType.simpleString()
    gains = gains_of(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))

    def score(batches):
        for batch in batches:
            rows = []
            for body in _bytes(batch.column(1)):
                words, found = features_of(body, n)
                rows.append((words, sum(found.values()), sum(gains[f % buckets] * times for f, times in found.items())))
            columns = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[:, i].copy()) for i in range(3))],
                                             names=["id", "n_words", "n_features", "weight"])

    weighed = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        score, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    return weighed.select(F.col("id").alias(doc_id), "n_words", "n_features", "weight",
                          (F.col("weight") + noise(F.col("id"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, doc_id: str = "doc_id",
             **options) -> DataFrame:
    """`weigh` plus `rank` (1, 2, ... for the drawn, null for the rest): of the N rows with at least
    `min_words` words, floor(percent * N / 100) of the highest scores are drawn, ties to the lesser
    id, null ids before all. Ranks come from a range-partitioned sort; nothing is ordered in one task."""
    (place,) = fresh([doc_id], "place")
    rows = cut(weigh(docs, target, doc_id, **options))
    fit = F.col("n_words") >= min_words
    drawn = rows.where(fit).count() * percent // 100
    ranked = global_rank(rows.where(fit), F.desc("score"), F.asc(doc_id), name=place)
    rank = F.when(F.col(place) < drawn, F.col(place) + 1).cast("long")
    return (ranked.withColumn("rank", rank).drop(place)
            .unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long"))))


def op13(spark, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
                   percent=10, min_words=20, n=1, buckets=10_000, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# DuckDB has no CRC-32: a table of 256 values is made by eight shifts, and distinct words run through it.
OP13_SQL = """
WITH t AS (SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
                       ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
lower_az AS (SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
             FROM documents
             UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
             FROM benchmark),
w AS (SELECT side, id, unnest(regexp_extract_all(x, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM lower_az),
n AS (SELECT side, id, word, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT word, xor(4294967295, list_reduce(
             list_transform(range(length(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT),
             lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) % 10000 AS bucket
      FROM (SELECT DISTINCT word FROM n), t),
f AS (SELECT side, id, bucket, sum(n)::BIGINT AS n FROM n JOIN b USING (word) GROUP BY ALL),
total AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS big_s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS big_t FROM f),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE + 1) * (any_value(big_s) + 10000)
                / ((coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE + 1) * (any_value(big_t) + 10000))))::BIGINT AS gain
         FROM f, total GROUP BY bucket),
per AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
s AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
      FROM documents LEFT JOIN per ON per.id = doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM s WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM s LEFT JOIN r USING (doc_id)"""
