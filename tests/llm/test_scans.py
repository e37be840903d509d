"""Operators that judge rows: quality, secrets, personal data, pages, shards."""
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF, words
from pyspark.sql import functions as F

from codeweft.llm import html, pii, quality, secrets, sharding

ODD = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "x  y\n\nx  y", None), (4, "same line here\n" * 3, "b"),
       (5, "ab cd ef " * 3000, "c"), (6, "\t\x0b\r\n \x0c", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, and a column whose name operators use too."""
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumn("kept", F.lit("mine"))


def test_quality_counts(spark, documents):
    rows = {r.doc_id: r for r in quality.op5(spark, SF).collect()}
    assert len(rows) == len(documents)
    for doc_id, text in documents.items():
        w, r = words(text), rows[doc_id]
        seen, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i:i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_agrees_with_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in quality.op5(spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    assert rows and all(r.kept == bool(labels[r.doc_id]) for r in rows)


def test_quality_odd_rows(spark, odd):
    rows = quality.judge(odd).select("doc_id", F.col("kept").alias("own"), F.col("quality.n_words").alias("n"),
                                     F.col("quality.kept").alias("good")).collect()
    assert len(rows) == len(ODD) and {r.own for r in rows} == {"mine"}
    assert Counter(r.n for r in rows) == Counter(len(words(t)) for _, t, _ in ODD)
    assert not any(r.good for r in rows)
    assert quality.judge(odd.limit(0)).count() == 0
    stage = quality.quality_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert stage.columns == spark.read.parquet(f"{SF}/documents.parquet").columns


def test_line_rules(spark):
    text = "A plain sentence stands here.\nHome | News | Sport | Contact | Login\nAll rights reserved.\nWIN!! BIG!! NOW!!\nAnother plain one."
    r = quality.clean_lines(spark.createDataFrame([(text,)], "text string")).select("line_rules.*").head()
    assert r.cleaned == "A plain sentence stands here.\nAnother plain one." and r.n_kept_lines == 2


def brute_spans(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(secrets.KINDS):
        flags = re.I if pattern.startswith("(?i)") else 0
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in
                re.finditer(pattern.replace("(?i)", ""), text, flags) if len(m[group]) >= least]
    return ",".join(s for *_, s in sorted(out))


def test_secret_spans(spark, documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = secrets.op4(spark, SF).collect()
    want = con.execute(secrets.OP4_SQL)
    assert [d[0] for d in want.description] == list(rows[0].__fields__)
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
    assert {r.doc_id: r.spans for r in rows} == {d: brute_spans(t or "") for d, t in documents.items()}


def test_secret_ownership(spark):
    live, copied = "password=abcdefgh1", "token: 'é0000000000'  token: example-token-1"
    docs = spark.createDataFrame([(1, "o1", "ü " + live), (2, "o1", copied), (3, "o2", copied), (3, "o2", copied), (4, "o3", None)],
                                 "doc_id long, source string, text string")
    rows = secrets.scan(docs).collect()
    assert len(rows) == 5
    got = {(r.doc_id, s.start, s.end, s.live, s.n_owners) for r in rows for s in r.spans}
    assert got == {(1, 2, 2 + len(live), True, 1), (2, 22, 44, False, 2), (3, 22, 44, False, 2)}
    assert secrets.scan(docs.limit(0)).count() == 0


def test_surrogates(spark):
    text = ("Mr. John Smith wrote to Frau Anna Bauer at j.smith9@mail.example.org, card 4111 1111 1111 1111, from 10.2.3.4; "
            "Mr. Smith called +1 (212) 555-0100. госпожа Ирина Петрова")
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (3, "plain"), (4, text), (5, "j.smith9@mail.example.org")],
                                 "doc_id long, text string").withColumn("kind", F.lit(7))
    rows = sorted(pii.pseudonymise(docs, "k").collect(), key=lambda r: (r.doc_id, r.text or ""))
    assert [r.n_entities for r in rows] == [8, 0, 0, 0, 8, 1] and {r.kind for r in rows} == {7}
    new = rows[0].text
    assert new == rows[4].text and rows[2].text == "" and rows[3].text == "plain" and rows[1].text is None
    for old in ("John", "Smith", "Anna", "Bauer", "j.smith9", "4111 1111", "10.2.3.4", "555-0100", "Ирина", "Петрова"):
        assert old not in new
    assert re.search(rows[5].text.replace(".", "\\."), new)                       # coreference over documents
    first, again = re.search(r"Mr\. (\w+) (\w+) wrote", new), re.search(r"Mr\. (\w+) called", new)
    assert first[2] == again[1] and first[1].endswith("us") and re.search(r"Frau \w+ina ", new)
    assert re.search(r"госпожа [а-яА-Я]+ [а-яА-Я]+$", new) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)
    card = re.search(r"card ([\d ]{19}),", new)[1].replace(" ", "")
    digits = [int(c) for c in card[::-1]]
    assert sum(digits[0::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0


def test_surrogates_stay_distinct(spark):
    values = spark.range(3000).select(F.lit("ssn").alias("kind"), F.format_string("%03d-%02d-%04d", F.col("id") % 7, F.col("id") % 5,
                                                                                 "id").alias("value")).distinct()
    out = pii.assign(values, "k").collect()
    assert len({r.surrogate for r in out}) == len(out) == values.count()
    assert not {r.surrogate for r in out} & {r.value for r in out}


def test_no_entity_survives(spark, documents):
    pattern = re.compile(r"[\w.+-]+@mail\d\.example\.com|\b\d{16}\b|\+1 \(\d{3}\) 555-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b")
    for r in pii.op1(spark, SF).collect():
        old = pattern.findall(documents[r.doc_id] or "")
        assert not any(x in r.text for x in old) and (old or r.text == documents[r.doc_id])


def test_pages(spark):
    page = ('<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice"><p>We use cookies on '
            'this site to do things.</p></div><article><h1>Head &amp; line</h1><p>One <b>bold\n word</b>.<p>Two</p><script>x("</p>")'
            '</script><aside>Side</aside></article><section id="comments"><p>I liked this very much indeed.</p></section><footer>F</fo')
    docs = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (3, "u", ""), (4, None, "<p>cut <")],
                                 "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = sorted((r.page_id, r.text) for r in html.extract(docs).collect())
    assert got == [(1, "Head & line One bold word . Two".replace(" .", ".")), (2, ""), (3, ""), (3, ""), (4, "cut <")]
    assert html.extract(docs.limit(0)).count() == 0
    named = html.extract(docs.select("page_id", "html", F.col("url").alias("__html"), F.lit(7).alias("n_main")))
    assert named.columns == ["page_id", "__html", "text", "n_blocks", "n_main"]
    assert sorted((r.page_id, r["__html"], r.n_main) for r in named.collect() if r.page_id == 1) == [(1, "u", 3)]


def test_articles_of_table(spark):
    import html as entities
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = html.op8(spark, SF).collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", source[r.page_id], re.S)[1]
        assert r.text == " ".join(entities.unescape(re.sub(r"<[^>]*(>|\Z)", " ", inner)).split()) and r.n_chars == len(r.text)
    assert len(rows) == len(source)


def test_tree_on_held_out_blocks(spark):
    table = html.LABELLED
    tree = html.train_tree(spark, table[0::2] + table[1::4])
    held = table[3::4]
    assert sum(html.is_main(tree, r[:-1]) == bool(r[-1]) for r in held) >= 0.8 * len(held)


def test_shards(spark, documents):
    rows = sharding.op10(spark, SF).collect()
    slots = defaultdict(list)
    for r in rows:
        raw = (documents[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(documents) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[j]) for j in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_odd_rows(spark):
    few = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "slot_id long, rank string")
    out = sharding.shuffle_to_shards(few, ["slot_id", "rank"], 5).collect()
    assert len(out) == 3 and all(r.slot == 0 for r in out) and len({r.shard for r in out}) == 3
    assert sharding.shuffle_to_shards(few.limit(0), ["slot_id"], 5).count() == 0


def test_communication_matrix_is_uniform():
    import numpy as np
    draws = np.array([sharding.communication_matrix([3, 5, 4], 4, s) for s in range(4000)])
    assert (draws.sum(axis=1) == [3, 3, 3, 3]).all() and (draws.sum(axis=2) == [3, 5, 4]).all()
    # mean of a hypergeometric count: part * shard / total
    assert abs(draws.mean(axis=0) - np.outer([3, 5, 4], [3, 3, 3, 3]) / 12).max() < 0.05


def test_communication_matrix_beyond_a_billion_rows():
    """Margins are exact for any counts, and counts lie where a uniform permutation puts them."""
    for sizes in ([10**9 + 5], [3 * 10**9, 7, 0, 10**9], [10**12, 10**12 + 1]):
        got = sharding.communication_matrix(sizes, 24, 3)
        total = sum(sizes)
        assert got.min() >= 0 and got.sum(axis=1).tolist() == sizes
        assert got.sum(axis=0).tolist() == [total // 24 + (j < total % 24) for j in range(24)]
        for n, row in zip(sizes, got):
            assert np.all(np.abs(row - n / 24) <= 6 * np.sqrt(n / 24) + 6)


def test_own_hypergeometric_is_numpys(monkeypatch):
    """With the limit lowered the halving draws have the same law as the library's."""
    monkeypatch.setattr(sharding, "SMALL", 3)
    rng = np.random.Generator(np.random.PCG64(1))
    for good, bad, n in ((30, 50, 20), (5, 200, 60), (200, 5, 60), (7, 7, 14), (0, 9, 3), (9, 0, 3), (4, 4, 0)):
        mine = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(4_000)])
        theirs = rng.hypergeometric(good, bad, n, 4_000) if n else np.zeros(4_000)
        assert mine.min() >= max(0, n - bad) and mine.max() <= min(n, good)
        assert abs(mine.mean() - theirs.mean()) < 0.15 and abs(mine.std() - theirs.std()) < 0.15


def test_many_secrets_in_one_text(spark):
    """Time grows with the number of matches, and offsets stay right over many blocks."""
    import time
    n = 40_000
    text = " ".join(f"token={i:08d}" for i in range(n))
    df = spark.createDataFrame([(1, "s", text), (2, "s", "é token: \"abcdefgh\"")], "doc_id long, source string, text string")
    begin = time.time()
    spans = secrets.find_spans(df).where("doc_id = 1").select("spans").first()[0]
    assert time.time() - begin < 30
    assert [(s.start, s.end) for s in spans] == [(i * 15, i * 15 + 14) for i in range(n)]
    other = secrets.find_spans(df).where("doc_id = 2").select("spans").first()[0]
    assert [(s.start, s.end, s.value) for s in other] == [(2, 18, "abcdefgh")]


def test_link_words_at_any_depth():
    for depth in (1, 3, 9, 40):
        page = "<p><a href=x>" + "<b>" * depth + "four words of link" + "</b>" * depth + "</a> and text</p>"
        (block,) = html.blocks_of(page)
        assert block[1:3] == (6, 4)


def test_long_one_line_texts_are_clean(spark):
    """Length alone fails no rule, nor does a phrase somewhere in a long line; loops and short notices do."""
    rng = np.random.Generator(np.random.PCG64(4))
    natural = " ".join(f"w{k}" for k in rng.zipf(1.3, 20_000) % 3_000)        # words repeat as in language
    rows = [(1, " ".join(f"w{i}" for i in range(20_000)) + " powered by us"), (2, natural), (3, "one two three four " * 5_000),
            (4, "Tous droits réservés 2024\n" + " ".join(f"mot{i}" for i in range(60)))]
    got = {r.doc_id: r.quality for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].lost_chars == 0 and got[2].lost_chars == 0
    assert got[3].lost_chars > 0 and not got[3].kept
    assert got[4].kept and "droits" not in got[4].cleaned
