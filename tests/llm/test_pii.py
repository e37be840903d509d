"""Personal data: mentions, formats and texts rebuilt in plain Python; only the draws themselves are the library's."""
import re

import regex
from conftest import SF

from codeweft.llm import pii

DOCS = "doc_id long, text string"
FINDER = regex.compile(pii.ANY)
TITLES = {"m": pii.MALE, "f": pii.FEMALE}


def kind_of(match):
    return next(k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, match))


def norm(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind in ("card", "ssn"):
        return digits
    if kind == "phone":
        return ("+" if value[0] == "+" else "") + digits
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind == "email" else value if kind == "ip" else value[0].upper() + value[1:].lower()


def parts(text):
    """[(text before, kind, value)], rest: every mention, names of titled persons in the rest of the text too."""
    out, at, names = [], 0, {}
    for m in FINDER.finditer(text):
        kind, gap = kind_of(m[0]), text[at:m.start()]
        at = m.end()
        if kind != "person":
            out.append((gap, kind, m[0]))
            continue
        title, *name = m[0].split(" ")
        gender = next((g for g, ts in TITLES.items() if any(regex.fullmatch(t, title) for t in ts)), None)
        if len(name) == 2:
            gender = gender or ("f" if regex.search("[aа]$|[άα]$", name[0]) else "n")
            out += [(f"{gap}{title} ", f"given_{gender}", name[0]), (" ", "surname", name[1])]
        else:
            out.append((f"{gap}{title} ", "surname", name[0]))
    rest = text[at:]
    for _, kind, value in out:
        if kind == "surname" or kind.startswith("given"):
            for form in (value, value.upper()):
                names.setdefault(form, kind)
    if not names:
        return out, rest
    bare = regex.compile("(?<![\\p{L}\\p{N}])(?:" + "|".join(map(regex.escape, names)) + ")(?![\\p{L}\\p{N}])")
    fine = []
    for gap, kind, value in [*out, (rest, None, None)]:
        at = 0
        for m in bare.finditer(gap):
            fine.append((gap[at:m.start()], names[m[0]], m[0]))
            at = m.end()
        fine.append((gap[at:], kind, value))
    return fine[:-1], fine[-1][0]


def fill(template, values, kind="[0-9]"):
    values = list(values)
    return "".join(values.pop(0) if re.fullmatch(kind, c) else c for c in template) + "".join(values)


def written(kind, mention, s):
    if kind in ("card", "ssn", "phone"):
        return fill(mention, re.sub("[^0-9]", "", s))
    if kind == "iban":
        return fill(mention, s, "[A-Z0-9]")
    return s.upper() if kind != "ip" and len(mention) > 1 and mention == mention.upper() != mention.lower() else s


def rebuild(spark, texts, key):
    found = {t: parts(t) for t in texts if t}
    entities = sorted({(k, norm(k, v)) for items, _ in found.values() for _, k, v in items})
    made = {(r.kind, r.value): r.surrogate for r in pii.assign(spark.createDataFrame(entities, "kind string, value string"), key).collect()}
    assert len({(k, s) for (k, _), s in made.items()}) == len(made) and not set(made.values()) & {v for _, v in made}
    return {t: "".join(g + written(k, v, made[k, norm(k, v)]) for g, k, v in items) + rest for t, (items, rest) in found.items()}


TEXTS = [
    "Call +1 (212) 555-0100 or +1-212-555-0100, else 212 555 0100. A.Bee@mail.example.org, a.bee@mail.example.org, A.BEE@MAIL.EXAMPLE.ORG",
    "Dr. Anna Keller came. Keller said Anna left; KELLER'S Annabelle and McAnna stay. Mr. Keller",
    "Anna Keller without a title, then Frau Keller and again Keller.", "jörg.müller@firma.de, иван@почта.рф; x@y.zz",
    "4111 1111 1111 1111 and 4111111111111111 and 4111-1111-1111-1111, 123-45-6789",
    "DE89 3704 0044 0532 0130 00 is DE89370400440532013000", "госпожа Ирина Петрова. Петрова и Ирина", "1.2.3.4 999.1.1.1", "plain"]


def test_formats_names_and_scripts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), DOCS)
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    want = rebuild(spark, TEXTS, "k")
    assert {i: r.text for i, r in got.items()} == {i: want[t] for i, t in enumerate(TEXTS)}
    first = got[0].text
    digits = [re.sub("[^0-9]", "", x) for x in re.findall(r"\+1[^a-z,]*\d", first)]
    assert len(digits) == 2 and digits[0] == digits[1] != "12125550100"
    mails = re.findall(r"[^ ,]+@[^ ,]+", first)
    assert len(mails) == 3 and len({m.lower() for m in mails}) == 1 and mails[2].isupper()
    assert not re.search(r"\b(Anna|Keller|KELLER)\b", got[1].text) and "Annabelle and McAnna stay" in got[1].text
    assert got[1].n_entities == 5 and got[1].entity_kinds == ["person"] * 5
    assert "jö" not in got[3].text and "иван" not in got[3].text
    cards = re.findall(r"(?:\d[ -]?){15}\d", got[4].text)
    assert len({re.sub("[ -]", "", c) for c in cards}) == 1 and [len(c) for c in cards] == [19, 16, 19]
    one, two = got[5].text.split(" is ")
    assert one.replace(" ", "") == two and int("".join(str(int(c, 36)) for c in two[4:] + two[:4])) % 97 == 1


def test_query_is_rebuilt(spark, documents):
    got = {r.doc_id: r.text for r in pii.op1(spark, SF).collect()}
    want = rebuild(spark, set(documents.values()), pii.KEY)
    assert got == {d: want.get(t, t) for d, t in documents.items()}
    assert sum(got[d] != t for d, t in documents.items()) > 10


def test_more_values_than_shapes(spark):
    """Two top-level domains, 676 shapes for 1,352 addresses; ten thousand short phones."""
    az = "abcdefghijklmnopqrstuvwxyz"
    mails = [("email", f"{a}@{b}.{t}") for a in az for b in az for t in ("com", "org")]
    phones = [("phone", f"+1{i:04d}") for i in range(10_000)]
    out = pii.assign(spark.createDataFrame(mails + phones, "kind string, value string"), "k").collect()
    assert len(out) == len({(r.kind, r.surrogate) for r in out}) == len(mails) + len(phones)
    assert not {r.surrogate for r in out} & {r.value for r in out}


def test_odd_rows(spark):
    mail = "a.b@mail.example.org"
    long = f"{mail} Mr. Smith and words " * 3_000
    rows = [(1, None, 1, "x"), (2, "", 1, "x"), (3, mail, 2, "y"), (3, mail, 2, "y"), (None, long, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_entities int, __row string")
    out = pii.pseudonymise(docs, "k")
    assert out.columns == ["doc_id", "text", "__row", "n_entities", "entity_kinds"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 5 and got[1].text is None and got[2].text == "" and got[3].n_entities == 1
    assert got[None].n_entities == 6_000 and mail not in got[None].text and got[None].text.count(got[3].text) == 3_000
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0
    other = docs.withColumnRenamed("text", "body")
    assert {r.body for r in pii.pseudonymise(other, "k", text="body").collect()} == {r.text for r in got.values()}
