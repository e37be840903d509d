"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes a set of word shingles, a MinHash signature and band keys. Texts with equal
   sets are one class; only its representative goes on.
2. In each band bucket every member is compared with the bucket's least member, its hub. Links
   found so give components; a bucket whose members are all in one component needs no more. In
   the others members are compared once more with a drawn hub of another component. Texts that
   then still share a bucket over different components are tested exactly in tiles: pairs of
   slices of bounded size, one matrix product of set incidence each, of which only links that tie
   components leave the task. Before that, texts that cannot be linked at all go: of n shingles,
   e of them exclusive to a text, n - e at most are shared. No candidate link is lost, and no
   table of pairs is made.
3. A comparison reads signatures batch by batch and stops as soon as the posterior probability
   that the similarity reaches the threshold falls below `miss`. What survives is verified on
   full shingle sets.
4. Links become components by star contraction (components.py)."""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .components import components
from .text import fresh
from .words import mix, shingle_sets, words_of

BATCH = 24                      # signature values compared at once
ROUNDS = 1                      # of drawn hubs, before the rest is compared pair by pair
_STEP = 1 << 14                 # shingles hashed at once for one text
TILE = 256                      # texts in one side of a tile


@lru_cache(maxsize=8)
def banding(threshold: float, miss: float) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold shares a band but for a probability of `miss`."""
    rows = 5 if threshold >= 0.85 else 4
    return math.ceil(math.log(miss) / math.log(1 - threshold ** rows)), rows


@lru_cache(maxsize=64)
def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches among n signature values with P(similarity >= threshold | matches) >= miss,
    under a uniform prior: the posterior is Beta(m + 1, n - m + 1), its tail a binomial sum."""
    term = lambda i: math.comb(n + 1, i) * threshold ** i * (1 - threshold) ** (n + 1 - i)
    total = 0.0
    for m in range(n + 1):
        total += term(m)
        if total >= miss:
            return m
    return n


def _signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _STEP):
        np.minimum(out, (shingles[i:i + _STEP, None] * a + b).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, k: int, threshold: float, miss: float) -> DataFrame:
    """(doc_id, n_shingles, key, signature, bands) of each row; texts of equal sets share `key`."""
    bands, rows = banding(threshold, miss)
    rng = np.random.Generator(np.random.PCG64(17))
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n, keys, signatures, band_keys = [], [], [], []
            for s in shingle_sets(words_of(batch.column("text"), lower=True), k):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig = _signature(s, a, b)
                signatures.append(sig.tobytes())
                h = salt.copy()
                for col in sig.reshape(bands, rows).T:
                    h = mix(h ^ col.astype(np.uint64))
                band_keys.append(h.astype(np.int64))
            lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * bands,
                                             np.concatenate(band_keys) if band_keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(signatures, pa.binary()), lists], names=names)

    names = ["doc_id", "n_shingles", "key", "signature", "bands"]
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles bigint, key binary, signature binary, bands array<bigint>")


def prune(pairs: DataFrame, signatures: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The (u, v) whose signatures leave the threshold possible, compared batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.stack([np.frombuffer(x.as_py(), np.uint32) for x in batch.column(c)]) for c in ("su", "sv"))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for at in range(0, a.shape[1], BATCH):
                end = min(at + BATCH, a.shape[1])
                matches[alive] += (a[alive, at:end] == b[alive, at:end]).sum(axis=1)
                alive = alive[matches[alive] >= least_matches(end, threshold, miss)]
                if not len(alive):
                    break
            yield batch.select(["u", "v"]).take(pa.array(alive))

    one = lambda c: signatures.select(F.col("doc_id").alias(c), F.col("signature").alias(f"s{c}"))
    return pairs.join(one("v"), "v").join(one("u"), "u").select("u", "v", "su", "sv").mapInArrow(run, "u bigint, v bigint")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The (u, v) with 100 * intersection >= percent * union on full shingle sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (shingle_sets(words_of(batch.column(c), lower=True), k) for c in ("tu", "tv"))
            good = []
            for i, (x, y) in enumerate(zip(a, b)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            yield batch.select(["u", "v"]).take(pa.array(good, pa.int64()))

    one = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    # the hub's text comes last, so it is not carried through the other join
    return pairs.join(one("v"), "v").join(one("u"), "u").select("u", "v", "tu", "tv").mapInArrow(run, "u bigint, v bigint")


def exclusive(texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, e): how many shingles of each text no other of `texts` has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, s in zip(ids, shingle_sets(words_of(batch.column("text"), lower=True), k)):
                for at in range(0, len(s), _STEP):
                    part = s[at:at + _STEP]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), doc_id)), pa.array(part.astype(np.int64))],
                                                     names=["doc_id", "shingle"])

    each = texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, shingle bigint")
    return (each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
            .groupBy("doc_id").agg(F.count("*").alias("e")))


def tiled(open_: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): links that tie different components, found by exact comparison inside each cluster of
    `open_` (doc_id, cluster, component). A cluster is cut into slices of about TILE texts and every
    pair of slices is one task; a task returns fewer links than it has texts."""
    slices = open_.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("slices"), F.count("*").alias("n")).where("n > 1")
    placed = (open_.join(slices.drop("n"), "cluster").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
              .withColumn("low", F.least("slice", "other")).withColumn("high", F.greatest("slice", "other")))

    def run(key, table):
        ids, label = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        side = table.column("slice").to_numpy()
        sets = list(shingle_sets(words_of(table.column("text"), lower=True), k))
        n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for at in range(0, len(values), 4096):                # columns of the incidence matrix
            a, b = np.searchsorted(column, (at, at + 4096))
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            both += part @ part.T
        wanted = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        wanted &= label[:, None] != label[None, :]
        if key[1].as_py() != key[2].as_py():
            wanted &= side[:, None] != side[None, :]
        root = {x: x for x in label.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in np.argwhere(np.triu(wanted, 1)).tolist():
            a, b = find(int(label[i])), find(int(label[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"u": pa.array([o[0] for o in out], pa.int64()), "v": pa.array([o[1] for o in out], pa.int64())})

    return (placed.join(texts.select("doc_id", "text"), "doc_id").groupBy("cluster", "low", "high")
            .applyInArrow(run, "u bigint, v bigint"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs` (doc_id long, text).

    Documents are linked if 100 * intersection >= percent * union of their distinct k-word shingles
    (A-Z folded; a shorter text is one shingle). component_id is the least doc_id reachable, kept
    marks it. Texts that are null, empty or without words have no shingles and stay alone, kept.
    Repeated rows of one doc_id repeat its result, that of the one whose set has the least key; other columns are not read. An empty table
    gives no rows. A row whose doc_id is null is alone, with a null component, and kept."""
    threshold = percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = cut(sketches(docs, k, threshold, miss))
    linkable = sets.where("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("key").agg(F.min("doc_id").alias("rep"))
    # one row for each class: its least document
    reps = linkable.join(classes.select(F.col("rep").alias("doc_id"), F.col("key").alias("rep_key")), "doc_id", "left_semi")
    rest = [c for c in reps.columns if c != "doc_id"]
    reps = reps.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "key").alias("one")).select("doc_id", "one.*")
    reps = cut(reps.drop("key"))
    members = reps.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    hubs = (members.groupBy("bucket").agg(F.min(F.struct("doc_id", "n_shingles")).alias("hub"), F.count("*").alias("n"))
            .where("n > 1").drop("n"))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    shared = cut(members.join(hubs, "bucket"))       # members of buckets that hold two or more
    star = (shared.where("doc_id <> hub.doc_id").where(fits(F.col("n_shingles"), F.col("hub.n_shingles")))
            .select(F.col("hub.doc_id").alias("u"), F.col("doc_id").alias("v")).distinct())

    # the texts that may have to be compared, once
    pool = cut(docs.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    def confirmed(pairs):
        return cut(verify(cut(prune(pairs, reps, threshold, miss)), pool, k, percent))

    def still_open(parts):
        """Members of buckets that lie in several components."""
        placed = shared.drop("hub", "component").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
            "component", F.coalesce("component", "doc_id"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
        return cut(placed.join(mixed.select("bucket"), "bucket", "left_semi"))

    tried = cut(star)
    links = confirmed(tried)
    parts = components(links)
    for turn in range(ROUNDS):
        shared = still_open(parts)                   # a bucket in one component stays so
        if not shared.limit(1).count():
            break
        drawn = shared.groupBy("bucket").agg(F.min(F.struct(
            F.xxhash64("bucket", "doc_id", F.lit(turn)).alias("draw"), "doc_id", "n_shingles", "component")).alias("hub"))
        pairs = cut(shared.join(drawn, "bucket").where("component <> hub.component")
                    .where(fits(F.col("n_shingles"), F.col("hub.n_shingles")))
                    .select(F.least("doc_id", "hub.doc_id").alias("u"), F.greatest("doc_id", "hub.doc_id").alias("v"))
                    .distinct().join(tried, ["u", "v"], "left_anti"))
        tried = tried.unionAll(pairs)
        links = links.unionAll(confirmed(pairs))
        parts = components(links)
    rest = still_open(parts)
    alone = exclusive(pool.join(rest.select("doc_id").distinct(), "doc_id", "left_semi"), k)
    rest = cut(rest.join(alone, "doc_id", "left")
               .where(100 * (F.col("n_shingles") - F.coalesce("e", F.lit(0))) >= percent * F.col("n_shingles"))
               .select("bucket", "doc_id", "component"))
    # texts that buckets tie together, whether linked or not
    least = rest.groupBy("bucket").agg(F.min("doc_id").alias("u"))
    clusters = components(rest.join(least, "bucket").select("u", F.col("doc_id").alias("v")))
    open_ = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(
        rest.select("doc_id", "component").distinct(), "doc_id")
    parts = components(links.unionAll(cut(tiled(open_, pool, k, percent))))
    found = (linkable.select("doc_id", "key").distinct().join(classes, "key")
             .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
             .groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id")))
    return (sets.select("doc_id", "n_shingles").join(found, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id"))))


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


def neardup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (5 words, 0.8) the least doc_id stays. Of rows that
    repeat a doc_id the one of least text stays (null first). Rows with a null doc_id, and texts that
    are null or without words, are copies of nothing and stay."""
    (row,) = fresh(docs.columns, "row")
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    one = left.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*[
        c for c in docs.columns if c != "doc_id"]), F.struct("text")).alias(row))
    return one.select(*[F.col(c) if c == "doc_id" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns]).unionByName(
        left.where("doc_id is null"))
