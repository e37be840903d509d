"""Surrogates for personal data, in DataFrame functions only.

Every distinct entity of the corpus gets one replacement, drawn by a keyed hash (SHA-512 of key,
kind, normal form and attempt): the same entity has the same surrogate everywhere. The normal form
is the digits of a card, phone or social number, an IBAN without spaces, an address in lower case,
a name in one letter case; what is drawn for it is written in each mention's own format (separators,
letter case). It keeps type, length pattern and script; cards and IBANs keep valid check digits;
names keep the gender that their title or ending shows. Names that a title gives away are replaced
in the rest of their text too. Draws that meet another entity's surrogate, or any entity found in
the corpus, are drawn again until all are distinct; after some draws addresses, phones and names
grow, so that this ends however many there are of one shape.

Texts without an entity never shuffle. The others are written once, cut into mentions and what lies
between them; only mentions are shuffled. Entities are made distinct with partial aggregation, so an
address in a third of all texts is one row per task; the join that brings surrogates back to all
mentions is narrow, and a skewed one is what adaptive execution splits."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .text import fresh

# Fixed patterns, tried in this order where several fit.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_NAME = "\\p{Lu}[\\p{L}'’-]+"
MALE = ("Mr\\.", "Herr", "Señor", "Sr\\.", "Don", "Monsieur", "Mister", "господин", "κύριος")
FEMALE = ("Mrs\\.", "Ms\\.", "Miss", "Frau", "Señora", "Sra\\.", "Madame", "Mme", "Doña", "госпожа", "κυρία")
NEUTRAL = ("Dr\\.", "Prof\\.", "доктор")
TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + ")"
PATTERNS = {
    "email": "[\\p{L}\\p{N}._%+-]+@(?:[\\p{L}\\p{N}-]+\\.)+\\p{L}{2,}",
    "iban": "\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\\b",
    "ip": f"(?<![0-9.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9]|\\.[0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": "(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": "(?:\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}"
             "|\\([0-9]{2,4}\\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "person": f"(?<![\\p{{L}}.]){TITLE} {_NAME}(?: {_NAME})?",
}
# Calling codes of one and of two digits; all others have three.
COUNTRY = "^\\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_HINTS = ("Mr.", "Herr ", "Señor", "Sr.", "Don ", "Monsieur ", "Mister ", "Mrs.", "Ms.", "Miss ", "Frau ", "Sra.",
          "Madame ", "Mme ", "Doña ", "Dr.", "Prof.", "господин", "госпожа", "доктор", "κύριος", "κυρία")
# Syllables of made-up names by script, and endings by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ha he ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se".split(),
    "cyrillic": "ба бе бо ва ве да де до за ка ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се та те то".split(),
    "greek": "βα γα δα δε δο κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πο ρα ρε ρι ρο σα σε τα τε το".split(),
}
ENDINGS = {
    "latin": {"m": "us", "f": "ina", "n": "el"}, "cyrillic": {"m": "ан", "f": "ина", "n": "ель"},
    "greek": {"m": "ος", "f": "ίνα", "n": "ιν"},
}


def _byte(digest: Column, i: Column) -> Column:
    """Byte i (modulo 64) of a SHA-512 in hex."""
    return F.conv(F.substr(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(value: Column, digest: Column) -> Column:
    """Each digit and letter replaced by one of its class, letters of other scripts by small Latin ones;
    all else stays."""
    def one(c, i):
        b = _byte(digest, i)
        return (F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
                .when(c.rlike("[a-z]"), F.char((b % 26 + 97).cast("long")))
                .when(c.rlike("[A-Z]"), F.char((b % 26 + 65).cast("long")))
                .when(c.rlike("\\p{L}"), F.char((b % 26 + 97).cast("long")))
                .when(c.rlike("\\p{N}"), (b % 10).cast("string")).otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _fill(template: Column, values: Column, kind: str = "[0-9]") -> Column:
    """`template` with its characters of a kind replaced in turn by those of `values`; what is over is
    put at the end."""
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))
    return F.aggregate(F.split(template, ""), start, lambda s, c: F.when(
        c.rlike(kind), F.struct((s["k"] + 1).alias("k"), F.concat(s["out"], F.substr(values, s["k"], F.lit(1))).alias("out")))
        .otherwise(F.struct(s["k"].alias("k"), F.concat(s["out"], c).alias("out"))),
        lambda s: F.concat(s["out"], F.substr(values, s["k"])))


def _extra(digest: Column, attempt: Column, kind: str) -> Column:
    """What a draw grows by: one letter or digit for every third attempt."""
    place = lambda i: _byte(digest, 64 - i)
    one = (lambda i: (place(i) % 10).cast("string")) if kind == "digit" else (lambda i: F.char((place(i) % 26 + 97).cast("long")))
    return F.when(attempt >= 3, F.array_join(F.transform(F.sequence(F.lit(1), (attempt / 3).cast("int")), one), "")).otherwise("")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string that a check digit is to follow."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x)


def _check_digit(body: Column) -> Column:
    return F.pmod(F.lit(10) - _luhn(body) % 10, F.lit(10)).cast("string")


def _card(digits: Column, digest: Column) -> Column:
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), _shaped(F.substr(digits, F.lit(2), F.length(digits) - 2), digest))
    last = F.substr(digits, F.length(digits), F.lit(1))
    valid = _check_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == last
    return F.concat(body, F.when(valid, _check_digit(body)).otherwise((_byte(digest, F.lit(63)) % 10).cast("string")))


def _iban(value: Column, digest: Column) -> Column:
    country, rest = F.substr(value, F.lit(1), F.lit(2)), _shaped(F.substr(value, F.lit(5)), digest)
    number = F.transform(F.split(F.concat(rest, country, F.lit("00")), ""),
                         lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    mod = F.aggregate(number, F.lit(0), lambda s, x: (s * F.when(x > 9, 100).otherwise(10) + x) % 97)
    return F.concat(country, F.lpad((98 - mod).cast("string"), 2, "0"), rest)


def _phone(value: Column, digest: Column, attempt: Column) -> Column:
    code = F.regexp_extract(value, COUNTRY, 0)
    return F.concat(code, _shaped(F.substr(value, F.length(code) + 1), digest), _extra(digest, attempt, "digit"))


def _ip(value: Column, digest: Column) -> Column:
    return F.array_join(F.transform(F.split(value, "\\."), lambda c, i: (
        (_byte(digest, i * 2) * 256 + _byte(digest, i * 2 + 1)) % 254 + 1).cast("string")), ".")


def _email(value: Column, digest: Column, attempt: Column) -> Column:
    """Local part and domain labels keep their shape; the last label becomes the reserved "example"."""
    kept = F.regexp_replace(value, "[^.]*$", "")
    return F.concat(_extra(digest, attempt, "letter"), _shaped(kept, digest), F.lit("example"))


def _name(value: Column, digest: Column, attempt: Column, gender: str | None) -> Column:
    """Capitalised syllables of the value's script; more of them after failed draws."""
    def of(script):
        table = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        made = F.array_join(F.transform(F.sequence(F.lit(0), 2 + attempt), lambda i: F.get(
            table, _byte(digest, i) % len(SYLLABLES[script]))), "")
        return F.initcap(F.concat(made, F.lit(ENDINGS[script][gender]) if gender else F.lit("")))
    return F.when(value.rlike("\\p{IsCyrillic}"), of("cyrillic")).when(value.rlike("\\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def normal_form(kind: Column, value: Column) -> Column:
    """What all mentions of one entity have in common, however they are written."""
    return (F.when(kind.isin("card", "ssn"), _digits(value))
            .when(kind == "phone", F.concat(F.regexp_extract(value, "^\\+", 0), _digits(value)))
            .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
            .when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(F.initcap(F.lower(value))))


def written_like(kind: Column, mention: Column, surrogate: Column) -> Column:
    """A surrogate (of a normal form) in the format of a mention."""
    return (F.when(kind.isin("card", "ssn", "phone"), _fill(mention, _digits(surrogate)))
            .when(kind == "iban", _fill(mention, surrogate, "[A-Z0-9]")).when(kind == "ip", surrogate)
            .when((F.length(mention) > 1) & (mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(surrogate))
            .otherwise(surrogate))


def draw(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate that `attempt` gives for an entity in its normal form."""
    digest = F.sha2(F.concat_ws("\u0000", F.lit(key), kind, value, attempt.cast("string")), 512)
    made = {"email": _email(value, digest, attempt), "iban": _iban(value, digest), "ip": _ip(value, digest),
            "ssn": F.concat(F.lit("9"), F.substr(_shaped(value, digest), F.lit(2))),
            "card": _card(value, digest), "phone": _phone(value, digest, attempt), "surname": _name(value, digest, attempt, None)}
    made |= {f"given_{g}": _name(value, digest, attempt, g) for g in "mfn"}
    return reduce(lambda c, k: c.when(kind == k, made[k]), made, F.when(F.lit(False), value))


MAX_DRAWS = 100


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value) rows in normal form: no two values of a kind
    share a surrogate, and none is a value of the corpus. Where draws meet, the one of fewer attempts,
    then the lesser value, stays and the others draw again. Kinds whose format leaves no room to grow
    (card, iban, ip, ssn) raise after MAX_DRAWS attempts, which takes more values than the format has."""
    state = cut(entities.withColumn("attempt", F.lit(0)))
    taken = state.select(F.col("value").alias("surrogate")).distinct()
    for _ in range(MAX_DRAWS):
        drawn = state.withColumn("surrogate", draw(F.col("kind"), F.col("value"), F.col("attempt"), key))
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value"))["value"].alias("first"))
        judged = cut(drawn.join(first, ["kind", "surrogate"])
                     .join(taken.withColumn("real", F.lit(True)), "surrogate", "left")
                     .withColumn("again", (F.col("value") != F.col("first")) | F.col("real").isNotNull()))
        open_ = judged.where("again").select("kind").limit(1).collect()
        if not open_:
            return judged.select("kind", "value", "surrogate")
        state = judged.select("kind", "value", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise ValueError(f"more values of kind {open_[0].kind} than their format has surrogates")


def _kind(match: Column) -> Column:
    return F.coalesce(*[F.when(match.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()])


def _gender(match: Column) -> Column:
    given = F.element_at(F.split(match, " "), 2)
    return (F.when(match.rlike("^(?:" + "|".join(MALE) + ") "), "m").when(match.rlike("^(?:" + "|".join(FEMALE) + ") "), "f")
            .when(given.rlike("[aа]$|[άα]$"), "f").otherwise("n"))


ITEMS = "array<struct<before:string,kind:string,value:string,label:string>>"


def _item(before: Column, kind: Column, value: Column, label: Column) -> Column:
    return F.struct(before.alias("before"), kind.alias("kind"), value.alias("value"), label.alias("label"))


def _items(gap: Column, match: Column) -> Column:
    """What of a match is replaced, each with the text before it: the match, or the names of a person
    (their title stays). Only the first part of a match has a label."""
    words, kind = F.split(match, " "), _kind(match)
    titled, none = F.concat(gap, F.get(words, 0), F.lit(" ")), F.lit(None).cast("string")
    surname, person = F.lit("surname"), F.lit("person")
    named = F.when(F.size(words) > 2, F.array(
        _item(titled, F.concat(F.lit("given_"), _gender(match)), F.get(words, 1), person),
        _item(F.lit(" "), surname, F.get(words, 2), none))).otherwise(F.array(_item(titled, surname, F.get(words, 1), person)))
    return F.when(kind == "person", named).otherwise(F.array(_item(gap, kind, match, kind)))


def _bare(before: Column, names: Column, pattern: Column) -> tuple[Column, Column]:
    """Mentions in `before` of names that the text gives with a title, and what comes after the last."""
    gaps, found = F.split(before, pattern, -1), F.regexp_extract_all(before, pattern, F.lit(0))
    kind = lambda m: F.get(F.filter(names, lambda n: m.isin(n["value"], F.upper(n["value"]))), 0)["kind"]
    items = F.transform(F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("m")), lambda z: z["m"].isNotNull()),
                        lambda z: _item(z["gap"], kind(z["m"]), z["m"], F.lit("person")))
    return items, F.element_at(gaps, -1)


def mentions_of(docs: DataFrame, text: str, items: str, tail: str) -> DataFrame:
    """`docs` plus `items` (mentions with the text before each) and `tail` (the text after the last)."""
    (names, matches) = fresh([*docs.columns, items, tail], "names", "matches")
    body = F.col(f"`{text}`")
    hint = body.rlike("[0-9@]") | reduce(lambda a, b: a | b, (body.contains(h) for h in _HINTS))
    found = F.when(hint, F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn(matches, found).where(F.size(matches) > 0)
    zipped = F.filter(F.arrays_zip(F.split(body, ANY, -1).alias("gap"), F.col(matches).alias("m")), lambda z: z["m"].isNotNull())
    docs = (docs.withColumn(items, F.flatten(F.transform(zipped, lambda z: _items(z["gap"], z["m"]))))
            .withColumn(tail, F.element_at(F.split(body, ANY, -1), -1)).drop(matches)
            .withColumn(names, F.array_distinct(F.transform(
                F.filter(items, lambda x: x["kind"].startswith("given") | (x["kind"] == "surname")),
                lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))))
    forms = F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n["value"], F.upper(n["value"])))))
    pattern = F.concat(F.lit("(?<![\\p{L}\\p{N}])(?:"), F.array_join(F.transform(
        forms, lambda f: F.concat(F.lit("\\Q"), f, F.lit("\\E"))), "|"), F.lit(")(?![\\p{L}\\p{N}])"))

    def finer(x: Column) -> Column:
        bare, rest = _bare(x["before"], F.col(names), pattern)
        return F.concat(bare, F.array(_item(rest, x["kind"], x["value"], x["label"])))

    last, rest = _bare(F.col(tail), F.col(names), pattern)
    some = F.size(names) > 0
    return docs.withColumns({
        items: F.when(some, F.concat(F.flatten(F.transform(items, finer)), last)).otherwise(F.col(items)).cast(ITEMS),
        tail: F.when(some, rest).otherwise(F.col(tail))}).drop(names)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with entities in `text` replaced, plus `n_entities` (mentions replaced) and
    `entity_kinds` (their kinds in text order); columns of these names are replaced.

    Null stays null and empty stays empty, with no entities; a text without entities is returned
    as it is. Repeated rows give repeated rows, an empty table none. Helper columns avoid the names
    of `docs`. A text is cut into mentions in one task, its mentions meet again in one group."""
    row, items, tail, made = fresh(docs.columns, "row", "items", "tail", "made")
    others = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    docs = docs.select(*[F.col(f"`{c}`") for c in others])
    body = F.col(f"`{text}`")
    hint = body.rlike("[0-9@]") | reduce(lambda a, b: a | b, (body.contains(h) for h in _HINTS))
    plain = docs.where(~F.coalesce(hint & body.rlike(ANY), F.lit(False))).select(
        *[F.col(f"`{c}`") for c in others], F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("entity_kinds"))
    some = cut(mentions_of(docs, text, items, tail).drop(text).withColumn(row, F.monotonically_increasing_id()))
    mentions = some.select(row, F.posexplode(F.transform(items, lambda x: F.struct(
        x["kind"].alias("kind"), x["value"].alias("mention")))).alias("pos", "m")).select(
        row, "pos", "m.kind", "m.mention", normal_form(F.col("m.kind"), F.col("m.mention")).alias("value"))
    surrogates = assign(mentions.select("kind", "value").distinct(), key)
    new = (mentions.join(surrogates, ["kind", "value"])
           .select(row, "pos", written_like(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"))
           .groupBy(row).agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias(made)))
    replaced = F.concat(F.array_join(F.zip_with(items, made, lambda x, n: F.concat(x["before"], n["new"])), ""), F.col(tail))
    kinds = F.filter(F.transform(items, lambda x: x["label"]), lambda k: k.isNotNull())
    changed = some.join(new, row).select(
        *[replaced.alias(c) if c == text else F.col(f"`{c}`") for c in others], F.size(kinds).alias("n_entities"), kinds.alias("entity_kinds"))
    return plain.unionByName(changed)


KEY = "codeweft-surrogates"      # a deployment passes its own secret key


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, KEY)


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in `text` is replaced; n_chars follows. No row goes; null and empty
    texts stay, repeated rows get the same text."""
    out = pseudonymise(docs, KEY)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
