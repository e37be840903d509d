"""Call-graph ingest over small hand-written indexes."""
import json
import random

import pytest
from pyspark.sql import functions as F

from codeweft.constants import END_OF_LINE
from codeweft.functions import scip_symbols as S
from codeweft.operators import scip
from codeweft.operators.stabbing import resolve_enclosing, split_shared_bodies
from codeweft.sources import scip_json

P = "tool cargo shop 2.0 "


def _defn(rng, symbol, body=None):
    row = _use(rng, symbol, 1)
    return {**row, "enclosing_range": body} if body else row


def _use(rng, symbol, roles=0):
    return {"range": rng, "symbol": symbol if symbol.startswith("local ") else P + symbol, "symbol_roles": roles}


def _info(symbol, **kw):
    return {"symbol": P + symbol, **kw}


# A shop: a price trait with two implementors, whose members one document lists under one
# common body range, a caller in a third document, and a stated relationship in a fourth.
SHOP = {"metadata": {"tool_info": {"name": "maker", "version": "7"}}, "documents": [
    {"relative_path": "core/price.rs",
     "symbols": [_info("core/Price#", kind=53), _info("core/Price#net().", kind=70, display_name="net price"),
                 _info("core/Price#gross().", kind=83)],
     "occurrences": [_defn([2, 6, 11], "core/Price#", [2, 0, 14, 1]),
                     _defn([4, 7, 10], "core/Price#net().", [4, 4, 30]),
                     _defn([8, 7, 12], "core/Price#gross().", [8, 4, 11, 5]),
                     _use([9, 8, 11], "core/Price#net()."),
                     _use([20, 0, 5], "ext/log!", 8)]},
    {"relative_path": "core/book.rs",
     "symbols": [],
     "occurrences": [_defn([6, 11, 14], "core/impl#[Book][Price]net().", [5, 0, 40, 1]),
                     _use([7, 2, 3], "local 12"), _use([7, 9, 13], "core/round()."),
                     _defn([15, 11, 16], "core/impl#[Book][Price]gross().", [5, 0, 40, 1]),
                     _use([16, 9, 13], "core/round()."), _defn([17, 6, 7], "local 3", [17, 6, 7]),
                     _defn([30, 11, 15], "core/impl#[Book][Clone]copy().", [5, 0, 40, 1]),
                     _use([39, 0, 4], "core/round().")]},
    {"relative_path": "app/till.rs",
     "symbols": [_info("app/till().", kind=17)],
     "occurrences": [_defn([0, 3, 7], "app/till().", [0, 0, 9, 1]),
                     _defn([3, 8, 13], "app/till().(total)"),
                     _use([5, 4, 7], "core/Price#net()."), _use([12, 0, 3], "core/Price#net().")]},
    {"relative_path": "app/pack.rs",
     "symbols": [_info("app/Box#wrap().", relationships=[
         {"symbol": P + "core/Wrap#wrap().", "is_implementation": True, "is_type_definition": True},
         {"symbol": P + "core/Other#", "is_reference": True}]),
                 _info("app/ghost().", relationships=[{"symbol": P + "core/Wrap#", "is_implementation": True}])],
     "occurrences": [_defn([21, 5, 9], "app/Box#wrap().", [21, 0, 25, 1])]}]}


def _graph(spark, tmp_path, index, repo):
    path = tmp_path / "index.json"
    path.write_text(json.dumps(index, indent=1))
    return scip.ingest(scip_json.load(spark, str(path), repo))


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    return _graph(spark, tmp_path_factory.mktemp("shop"), SHOP, "org/shop")


def _edges(graph):
    t = graph.symbols.select(F.col("id").alias("symbol_id"), F.col("scip_symbol").alias("t"),
                             F.col("name").alias("t_name"))
    e = graph.symbols.select(F.col("id").alias("enclosing_symbol_id"), F.col("name").alias("e"),
                             F.col("path").alias("e_path"), F.col("start_line").alias("e_line"),
                             F.col("kind").alias("e_kind"))
    return graph.refs.join(t, "symbol_id").join(e, "enclosing_symbol_id", "left").collect()


def _descriptors(spark, symbols):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(symbols)], "i int, s string")
    rows = df.select("i", S.descriptors(F.col("s")).alias("d")).orderBy("i").collect()
    return [[(d["name"], d["kind"]) for d in r["d"]] for r in rows]


def _brute_descriptors(symbol):
    """Character walk used only to check the expression."""
    fields = symbol.split(" ", 4)
    text, out = (fields[4] if len(fields) == 5 else ""), []
    pos = 0
    while pos < len(text):
        first = text[pos]
        if first in "[(":
            close = text.find("])"["[(".index(first)], pos)
            if close < 0:
                return out
            out.append((text[pos + 1:close], "type_parameter" if first == "[" else "parameter"))
            pos = close + 1
            continue
        name = ""
        if first == "`":
            pos += 1
            while pos < len(text) and not (text[pos] == "`" and text[pos + 1:pos + 2] != "`"):
                name += text[pos]
                pos += 2 if text[pos] == "`" else 1
            pos += 1
        else:
            while pos < len(text) and text[pos] not in "/#.:!([":
                name += text[pos]
                pos += 1
        if pos >= len(text):
            return out
        if text[pos] == "(":
            close = text.find(")", pos)
            if close < 0:
                return out
            out.append((name, "method"))
            pos = close + 1 + (text[close + 1:close + 2] == ".")
            continue
        kind = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro"}.get(text[pos])
        if kind:
            out.append((name, kind))
        pos += 1
    return out


def test_descriptors_read_the_grammar(spark):
    got = _descriptors(spark, [P + "core/`a``b.ts`/Box#[T](x)wrap(+2).", P + "log!m:", P + "half/un(closed", "local 3"])
    assert got == [
        [("core", "namespace"), ("a`b.ts", "namespace"), ("Box", "type"), ("T", "type_parameter"),
         ("x", "parameter"), ("wrap", "method")],
        [("log", "macro"), ("m", "meta")], [("half", "namespace")], []]


def test_descriptors_agree_with_a_character_walk(spark):
    rng = random.Random(5)
    symbols = ["a b c d " + "".join(rng.choice("ab/#.:!()[]` x") for _ in range(rng.randint(0, 14)))
               for _ in range(3000)]
    assert _descriptors(spark, symbols) == [_brute_descriptors(s) for s in symbols]


def test_kind_prefers_the_tool(spark):
    sym = P + "core/Price#net()."
    d = S.descriptors(F.lit(sym))
    row = spark.range(1).select(
        S.symbol_kind(d, F.lit(17)).alias("a"), S.symbol_kind(d, F.lit(0)).alias("b"),
        S.symbol_kind(d, F.lit(83)).alias("c"), S.symbol_name(F.lit(sym), d).alias("n"),
        S.symbol_name(F.lit(sym), d, F.lit("shown")).alias("m")).first()
    assert tuple(row) == ("function", "method", "method", "net", "shown")


def _stab(spark, intervals, points):
    iv = spark.createDataFrame(
        [("d", a[0], a[1], b[0], b[1], i, p) for i, (a, b, p) in enumerate(intervals)],
        "doc string, s_line int, s_ch int, e_line int, e_ch int, ordinal int, who string")
    pt = spark.createDataFrame([("d", *p) for p in points], "doc string, line int, ch int")
    out = resolve_enclosing(pt, iv, ["doc"], "who").collect()
    return {(r["line"], r["ch"]): r["who"] for r in out}


@pytest.mark.parametrize("seed", range(4))
def test_stabbing_agrees_with_brute_force(spark, seed):
    rng = random.Random(seed)
    lines, chars = rng.choice([(6, 4), (40, 3), (300, 90), (3, 400)])
    spot = lambda: (rng.randint(0, lines), rng.randint(0, chars))
    intervals = []
    for i in range(80):
        a, b = sorted((spot(), spot()))
        if rng.random() < .1:
            b = (b[0], END_OF_LINE)
        intervals.append((a, b, f"i{i}"))
    points = {spot() for _ in range(300)}
    want = {}
    for p in points:
        inside = [(a, (-b[0], -b[1]), i, w) for i, (a, b, w) in enumerate(intervals) if a <= p <= b]
        want[p] = max(inside)[3] if inside else None
    assert _stab(spark, intervals, points) == want


@pytest.mark.parametrize("max_siblings", [100, 2])
def test_shared_bodies_are_sliced(spark, max_siblings):
    rng = random.Random(8)
    rows, want = [], {}
    for d in range(3):
        for start in (10, 50):
            names = [(start + rng.randint(0, 9), rng.randint(0, 3)) for _ in range(rng.choice([1, 4, 7]))]
            named = [(n, len(rows) + i) for i, n in enumerate(names)]
            rows += [(d, f"s{i}", i, start, 0, start + 30, 2, *n) for n, i in named]
            order = sorted(named)
            for (n, i), nxt in zip(order, order[1:] + [None]):
                end = (start + 30, 2) if nxt is None else (max(nxt[0][0] - 1, n[0]), END_OF_LINE)
                want[f"s{i}"] = (*(n if len(order) > 1 else (start, 0)), *end)
    df = spark.createDataFrame(rows, "doc int, symbol string, ordinal int, s_line int, s_ch int, e_line int, "
                                     "e_ch int, n_line int, n_ch int")
    got = {r["symbol"]: (r["s_line"], r["s_ch"], r["e_line"], r["e_ch"])
           for r in split_shared_bodies(df, ["doc"], max_siblings).collect()}
    assert got == want


def _symbol(graph, suffix):
    r = graph.symbols.where(F.col("scip_symbol") == P + suffix).first()
    return r and (r["name"], r["kind"], r["path"], r["start_line"], r["end_line"])


def test_symbols(shop):
    assert _symbol(shop, "core/Price#net().") == ("net price", "trait_method", "core/price.rs", 5, 5)
    assert _symbol(shop, "core/Price#gross().") == ("gross", "method", "core/price.rs", 9, 12)
    # shared range 5..40: each member from its name to the line before the next
    assert _symbol(shop, "core/impl#[Book][Price]net().") == ("net", "method", "core/book.rs", 7, 15)
    assert _symbol(shop, "core/impl#[Book][Clone]copy().") == ("copy", "method", "core/book.rs", 31, 41)
    assert _symbol(shop, "app/till().(total)") == ("total", "parameter", "app/till.rs", 4, 4)
    assert _symbol(shop, "core/round().") == ("round", "method", None, None, None)
    assert _symbol(shop, "ext/log!") == ("log", "macro", None, None, None)
    assert shop.symbols.where(F.col("scip_symbol").startswith("local ")).count() == 0


def test_references_are_attributed(shop):
    rows = [(r["t"][len(P):], r["path"], r["line"], r["e"]) for r in _edges(shop) if r["role"] == "reference"]
    assert sorted(rows, key=str) == sorted([
        ("core/Price#net().", "core/price.rs", 10, "gross"), ("ext/log!", "core/price.rs", 21, None),
        ("core/round().", "core/book.rs", 8, "net"), ("core/round().", "core/book.rs", 17, "gross"),
        ("core/round().", "core/book.rs", 40, "copy"),
        ("core/Price#net().", "app/till.rs", 6, "till"), ("core/Price#net().", "app/till.rs", 13, None)], key=str)


def test_edges_and_stats(shop):
    rows = {(r["role"], r["t"][len(P):], r["e"], r["path"], r["line"]) for r in _edges(shop) if r["role"] != "reference"}
    assert rows == {
        ("implementation", "core/Price#net().", "net", "core/book.rs", 7),
        ("implementation", "core/Price#gross().", "gross", "core/book.rs", 16),
        ("implementation", "core/Wrap#wrap().", "wrap", "app/pack.rs", 22),
        ("type_definition", "core/Wrap#wrap().", "wrap", "app/pack.rs", 22),
        ("implementation", "core/Wrap#", "ghost", None, None)}
    assert shop.stats.drop("repo").first().asDict() == {
        "documents": 4, "symbols": 14, "refs": 7, "refs_unresolved": 2, "relationships": 5, "impl_trait_not_local": 1}


def test_stabbing_hashes_its_blocks(spark):
    """Tiles are aggregated by rank: the many blocks of an interval are never sorted, whatever the payload is."""
    iv = spark.createDataFrame([("d", 0, 0, 900, 3, 1, "a"), ("d", 5, 2, 700, 1, 2, "b"), ("d", 5, 2, 700, 1, 2, None)],
                               "doc string, s_line int, s_ch int, e_line int, e_ch int, ordinal long, who string")
    pt = spark.createDataFrame([("d", 5, 2), ("d", 5, 1), ("d", 701, 0), ("d", 950, 0)], "doc string, line int, ch int")
    out = resolve_enclosing(pt, iv, ["doc"], "who")
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.line, r.ch): r.who for r in out.collect()} == {(5, 2): "b", (5, 1): "a", (701, 0): "a", (950, 0): None}


def test_documents_are_not_read_again_for_edges(spark, tmp_path):
    """What several edges need comes from written tables, and edges do not ask what all occurrences mention."""
    with open(tmp_path / "docs.json", "w") as fh:
        for i, d in enumerate(SHOP["documents"]):
            fh.write(json.dumps({"repo": "r", "doc": i, **d}) + "\n")
    flat = scip.flatten_documents(scip_json.read_documents(spark, str(tmp_path / "docs.json")))
    graph = scip.ingest(flat)
    assert graph.refs.count() > 0
    for read in (graph.refs, flat.infos, flat.relations):
        assert read.inputFiles() and not any(f.endswith(".json") for f in read.inputFiles())
    assert graph._parsed.where("path IS NULL").count() == 0
    assert {r.scip_symbol for r in graph.symbols.where("path IS NULL").collect()} >= {P + "ext/log!", P + "core/round()."}
    assert graph.symbols.count() == graph.symbols.select("id").distinct().count()
