"""Operators that compare texts: near-duplicates, repeats, containment, scoring, encoding, pipeline."""
import hashlib
import math
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, fold, words
from pyspark.sql import functions as F

from codeweft.llm import automaton, chunks, decontaminate, neardup, pieces, scoring, substrings
from codeweft.llm.components import components

DOCS = "doc_id long, text string"


def sets_of(texts, k):
    out = {}
    for d, t in texts.items():
        w = words(fold(t))
        out[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute_components(texts, k, percent):
    sets, parent = sets_of(texts, k), {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        for e, n in Counter(e for s in sets[d] for e in holders[s]).items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
        for s in sets[d]:
            holders[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in texts}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 100), (7, 7), (None, 3), (200, 199), (199, 300)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(50, 50), (100, 50), (199, 199), (200, 199), (300, 199)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, documents, k, percent):
    want = brute_components(documents, k, percent)
    rows = neardup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows)


def test_near_duplicates_around_the_threshold(spark):
    """A group whose members differ each on their own, a chain through it, and odd rows."""
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(40):
        w = list(base)
        for e in range(1 + d % 4):
            w[(d * 7 + e * 31) % 120] = f"own{d}x{e}"
        texts[d] = " ".join(w)
    texts |= {50: None, 51: "", 52: "one two", 53: "ONE two", 54: "one  two "}
    docs = spark.createDataFrame([*texts.items(), (52, "one two")], DOCS).withColumn("bucket", F.lit(0))
    rows = neardup.near_duplicates(docs, 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, 3, 85)
    assert len(rows) == len(texts) + 1
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_posterior_bound():
    low = neardup.least_matches(24, 0.85, 1e-6)
    tail = lambda m: sum(math.comb(25, i) * .85 ** i * .15 ** (25 - i) for i in range(m + 1))
    assert tail(low) >= 1e-6 > tail(low - 1)
    bands, rows = neardup.banding(0.8, 1e-6)
    assert (1 - 0.8 ** rows) ** bands <= 1e-6


def brute_repeats(texts, k=13):
    least = {}
    for d in sorted(texts):
        w = words(texts[d])
        for i in range(len(w) - k + 1):
            least.setdefault(tuple(w[i:i + k]), d)
    out = {}
    for d, t in texts.items():
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if least[tuple(w[i:i + k])] < d:
                gone |= set(range(i, i + k))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 20_000, "bucket_bytes": 30_000}])
def test_repeats(spark, documents, sizes):
    rows = substrings.repeats(spark.read.parquet(f"{SF}/documents.parquet"), 13, **sizes).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == brute_repeats(documents)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)


def test_repeats_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    passage = " ".join(f"p{i}" for i in range(13))
    texts = {1: passage, 2: f"x {passage}\ty", 3: None, 4: "", 5: long, 6: " ".join(passage.split()[:12]), 7: long}
    docs = spark.createDataFrame([*texts.items(), (1, passage)], DOCS).withColumn("chunk", F.lit(1))
    rows = substrings.repeats(docs, 13, chunk_bytes=1000, bucket_bytes=1000).collect()
    assert len(rows) == 8 and {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == brute_repeats(texts)
    assert substrings.repeats(docs.limit(0)).count() == 0


def test_containment(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(map(tuple, decontaminate.op7(spark, SF).collect())) == sorted(con.execute(decontaminate.OP7_SQL).fetchall())


def test_containment_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(30))
    part = " ".join(item.split()[:20])
    docs = spark.createDataFrame([(1, f"a {item} b"), (1, f"a {item} b"), (2, part), (3, None), (4, ""), (5, "x two words y"),
                                  (None, item)], DOCS).withColumn("item", F.lit(0))
    items = spark.createDataFrame([(7, item), (7, item), (8, "two words"), (9, None), (10, "")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained_items(docs, items).collect())
    assert got == Counter([(1, 7, 26), (5, 8, 1), (None, 7, 26)])
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0


def test_containment_in_other_case(spark):
    item = " ".join(f"Été{i} ночь{i} añ{i}o" for i in range(8))
    docs = spark.createDataFrame([(1, f"a {item.upper()} b"), (2, f"a {item.lower()} b"), (3, item.upper().replace("É", "E"))], DOCS)
    items = spark.createDataFrame([(7, item), (8, "ÜBER Öl")], "item_id long, text string")
    docs = docs.union(spark.createDataFrame([(4, "x über öl y")], DOCS))
    got = sorted((r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained_items(docs, items).collect())
    assert got == [(1, 7, 20), (2, 7, 20), (4, 8, 1)]
    kept = {r.doc_id for r in decontaminate.contained_items(docs, items, fold_case=False).collect()}
    assert not kept


def test_containment_of_most_of_an_item(spark):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(29))) for i in range(100)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("other "), F.substring_index("text", " ", -24)).alias("text"))
    got = decontaminate.contained_items(docs, items).collect()                # 20 of 25 shingles
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got} == {(i, i, 20) for i in range(100)}


def brute_scores(texts, held, order, m):
    seqs = {d: ["<s>", *words(fold(t)), "</s>"] for d, t in texts.items()}
    grams, contexts = Counter(), Counter()
    for d, s in seqs.items():
        for k in range(1, order + 1) if not held[d] else ():
            for i in range(max(1, k - 1), len(s)):
                grams[tuple(s[i - k + 1:i + 1])] += 1
                contexts[tuple(s[i - k + 1:i])] += 1
    n, v = contexts[()], len({g for g in grams if len(g) == 1})
    out = {}
    for d, s in seqs.items():
        base = total = known = 0
        for i in range(1, len(s)):
            c = grams[(s[i],)]
            p = (c + 1) / (n + v + 1)
            base, known = base + math.log10(p), known + (c > 0)
            for k in range(2, min(order, i + 1) + 1):
                g = tuple(s[i - k + 1:i + 1])
                p = (grams[g] + m * p) / (contexts[g[:-1]] + m)
            total += math.log10(p)
        out[d] = (held[d], len(s) - 1, known, n, base, total)
    return out


@pytest.mark.parametrize("order,sizes", [(2, {}), (1, {}), (4, {"chunk_bytes": 20_000}), (3, {"chunk_bytes": 20_000, "bucket_bytes": 30_000})])
def test_scores(spark, documents, order, sizes):
    texts = documents | {900001: None, 900002: "", 900003: "never seen-before wordz"}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    docs = spark.createDataFrame([(d, t, held[d]) for d, t in texts.items()], DOCS + ", held_out boolean").withColumn("chunk", F.lit(5))
    want, rows = brute_scores(texts, held, order, 200.0), scoring.score(docs, order, **sizes).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:5] == want[r.doc_id][:4] and tuple(r)[5:] == pytest.approx(want[r.doc_id][4:])
    assert scoring.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 5])
@pytest.mark.parametrize("segment", [1, 3, 7, 512])
def test_lanes_of_a_traversal(order, segment):
    texts = {i: " ".join("abcd"[(i * j * j + j // 3) % 4] for j in range(5 * i)) for i in range(12)} | {99: "a b never c d a"}
    held = {d: d % 3 == 0 for d in texts}
    want = brute_scores(texts, held, order, 2.0)
    table = pa.table({"text": list(texts.values()), "held_out": pa.chunked_array([pa.array(list(held.values()))])})
    tokens, levels, grams, _, at, start = scoring._chunk_grams(table, order, 1)
    counts = scoring._train_counts(table, tokens, levels, grams, at, start).astype(float)
    first = np.zeros(len(tokens.hashes), bool)
    first[tokens.offsets[:-1]] = True
    taught = [w for d, t in texts.items() if not held[d] for w in [*words(t), "</s>"]]
    model = automaton.build(at, [levels[0] == levels[0]] + [a != b for a, b in zip(levels[1:], levels)], first, counts, start,
                            len(taught), len(set(taught)), 2.0)
    assert automaton.traverse(model, at[0], tokens.offsets, segment) == pytest.approx([want[d][5] for d in texts])


def test_rows_without_id_are_dealt_by_text(spark):
    docs = spark.createDataFrame([(None, f"text {i} of many") for i in range(200)], DOCS)
    assert chunks.dealt(docs, chunk_bytes=100)[0].select("chunk").distinct().count() > 20
    got = scoring.score(docs.withColumn("held_out", F.lit(None).cast("boolean")), chunk_bytes=100).collect()
    assert len(got) == 200 and {(r.doc_id, r.held_out, r.n_known, r.train_tokens) for r in got} == {(None, False, 5, 1000)}


def test_model_sums_to_one_and_beats_its_root(spark):
    rows = scoring.op9(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert rows[0] > rows[1]
    texts = {1: "a b a b c", 2: "b b a"}
    probe = {3 + i: f"a {w}" for i, w in enumerate(["a", "b", "c", "unseen"])}
    docs = spark.createDataFrame([(d, t, d > 2) for d, t in (texts | probe).items()], DOCS + ", held_out boolean")
    # P(. | a) over all known words, the end and one unknown word
    got = {r.doc_id: r.score for r in scoring.score(docs).collect()}
    want = brute_scores(texts | probe, {d: d > 2 for d in texts | probe}, 2, 200.0)
    assert all(got[d] == pytest.approx(want[d][5]) for d in got)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_vocabulary())


def test_best_segmentation(codec):
    vocabulary = {p: s for p, s, kind in pieces.read_vocabulary() if kind == "normal"}

    def brute(text):
        best = [0.0] + [-math.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - codec.reach), j):
                s = vocabulary.get(text[i:j], codec.unknown if j - i == 1 else -math.inf)
                best[j] = max(best[j], best[i] + s)
        return best[-1]

    for text in ("hello there, world", "naïve  café\n\nx", "日本語 text", "a" * 50, "1,234.5% (x) don't"):
        ids = array("i")
        assert codec.encode(codec.normal(text), ids) == pytest.approx(brute(codec.normal(text)))
        assert codec.decode(ids) == text


def test_round_trip_and_scan(spark, codec):
    mixed = "the in é日\U0001f600 xyz\n ab  cd" * 60
    texts = [(1, mixed), (1, mixed), (2, None), (3, ""), (4, "thein" * 300), (5, " lead and trail "), (6, "x" * 41), (None, "null id")]
    docs = spark.createDataFrame(texts, DOCS).withColumn("seq", F.lit(1))
    one, scan = (pieces.encode(docs, chunk_chars=c, block=b).collect() for c, b in ((10_000, 4), (40, 3)))
    assert Counter((r.doc_id, tuple(r.ids)) for r in one) == Counter((r.doc_id, tuple(r.ids)) for r in scan)
    assert sorted(round(r.score, 3) for r in one) == sorted(round(r.score, 3) for r in scan)
    assert Counter((r.doc_id, codec.decode(r.ids)) for r in scan) == Counter((d, t or "") for d, t in texts)
    assert pieces.encode(docs.limit(0)).count() == 0


def test_ids_are_those_of_the_library(spark, documents):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = pieces.encode(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert r.ids == library.encode(documents[r.doc_id] or "")
        assert r.score == sum(map(library.get_score, r.ids))
    odd = ["the in é日\U0001f600 xyz\n ab  cd\r;{}▁\0" * 60, "thein" * 300, " " * 500, "x" * 3000, "日本語" * 90, " a ", "", "naïve\t\n"]
    docs = spark.createDataFrame(list(enumerate(odd)), DOCS)
    for size in (17, 40, 10_000):                      # split into chunks, and whole
        assert {r.doc_id: r.ids for r in pieces.encode(docs, chunk_chars=size).collect()} == dict(enumerate(map(library.encode, odd)))


def test_scan_of_unigram_kind(spark, codec):
    texts = ["the in é日\U0001f600 xyz\n ab  cd" * 60, "thein" * 300, "x" * 41]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    one, scan = ({r.doc_id: r for r in pieces.encode(docs, chunk_chars=c, block=3, bpe=False).collect()} for c in (10_000, 40))
    for d, t in enumerate(texts):
        ids = array("i")
        assert codec.encode(codec.normal(t), ids) == pytest.approx(one[d].score) == pytest.approx(scan[d].score)
        assert one[d].ids == list(ids) and codec.decode(scan[d].ids) == t


def test_products_are_associative(codec):
    text = codec.normal("some words and anotherverylongwordwithoutspaces in between")
    cuts = [0, 17, 30, len(text)]
    parts = [(text[a:b + codec.reach - 1], b - a) for a, b in zip(cuts, cuts[1:])]
    m = [codec.transfer(t, n, range(codec.reach)) for t, n in parts]
    left = pieces.product(pieces.product(m[0], m[1]), m[2])
    right = pieces.product(m[0], pieces.product(m[1], m[2]))
    assert (left == right).all() and left[0, 0] == pytest.approx(codec.forward(text, 0, len(text))[0][-1])


def test_digest_query(spark, documents):
    rows = pieces.op6(spark, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in documents.items()}


def test_pipeline(spark, codec):
    import corpus_pipeline
    from codeweft.llm.pii import KEY, pseudonymise
    from codeweft.llm.quality import judge
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id: r.cleaned for r in judge(docs).select("doc_id", "quality.*").where("kept").collect()}
    found = brute_components(good, 5, 80)
    left = {d: t for d, t in good.items() if found[d][1] == d}
    items = sets_of({r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}, 5)
    exact = lambda t, k=5: {tuple(w[i:i + k]) for w in [words(t)] for i in range(len(w) - k + 1)}
    raw = [exact(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len(raw) == len(items)
    clean = {d: t for d, t in left.items() if not any(len(i & exact(t)) >= 0.8 * len(i) for i in raw)}
    masked = {r.doc_id: r.text for r in pseudonymise(spark.createDataFrame(list(clean.items()), DOCS), KEY).collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: codec.decode(r.ids) for r in rows} == masked and len(rows) == len(masked)
