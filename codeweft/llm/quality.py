"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged by itself; lines that fail are taken out, and a document that
has lost too much of its text that way is rejected. All work is one projection per row: nothing
shuffles, so a hot source or a very long text needs no special care."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .text import SPACES, count_of, fresh, gram_hashes, has_word, without, words

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»«›‹•·>"
# Fixed phrases of licence, consent and navigation lines, by language.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "is licensed under", "terms of service",
    "privacy policy", "cookie policy", "we use cookies", "accept cookies", "subscribe to our newsletter",
    "sign up for our", "click here to", "powered by", "copyright (c)", "javascript is disabled",
    "enable javascript", "share on facebook", "share on twitter", "skip to content", "back to top",
    "alle rechte vorbehalten", "lizenziert unter", "nutzungsbedingungen", "datenschutzerklärung", "wir verwenden cookies",
    "cookies akzeptieren", "newsletter abonnieren", "hier klicken", "zum inhalt springen", "nach oben scrollen",
    "bereitgestellt von", "javascript ist deaktiviert", "auf facebook teilen", "auf twitter teilen",
    "tous droits réservés", "sous licence", "conditions d'utilisation", "politique de confidentialité",
    "nous utilisons des cookies", "accepter les cookies", "abonnez-vous à notre", "cliquez ici", "aller au contenu",
    "haut de page", "propulsé par", "javascript est désactivé", "partager sur facebook", "partager sur twitter",
    "todos los derechos reservados", "bajo licencia", "condiciones de uso", "política de privacidad",
    "usamos cookies", "utilizamos cookies", "aceptar cookies", "suscríbete a nuestro", "haz clic aquí", "saltar al contenido",
    "volver arriba", "desarrollado por", "javascript está desactivado", "compartir en facebook", "compartir en twitter",
)


def repeat_words(hashes: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more. `hashes` are those of its
    3-word windows; a text in which all differ is told by that alone.

    Otherwise windows are sorted as (hash, position), so that equal ones are neighbours; the
    positions of those that have an equal neighbour are sorted again and the union of their
    spans is counted."""
    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def again(windows: Column) -> Column:
        found = F.filter(windows, lambda w, i: F.coalesce(F.get(windows, i + 1)["h"] == w["h"], F.lit(False))
                         | F.coalesce(F.get(windows, i - 1)["h"] == w["h"], F.lit(False)))
        return F.sort_array(F.transform(found, lambda w: w["p"]))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, p: F.struct(
            (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    # each step binds its array once, as the argument of a one-element transform
    counted = F.get(F.transform(F.transform(F.array(keyed), again), covered), 0)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(counted)


def line_fails(line: Column, line_words: Column, max_symbols: float = 0.05, max_marks: float = 0.3,
               max_separators: float = 0.15, min_unique: float = 0.3, long_line: int = 10, phrase_line: int = 30) -> Column:
    """True for a line that fails one of the rules:

    punctuation: symbols above `max_symbols` of its characters, or "!!"/"??" for more than
    `max_marks` of its words; navigation: separators for more than `max_separators` of its words
    (three or more of them); boilerplate: a fixed phrase in a line of `phrase_line` words at most, or
    in a line of `long_line` words or more fewer than `min_unique` distinct 3-word windows among all.
    The share of distinct windows hardly falls with the length of clean text, as that of words does,
    and a phrase somewhere in a long line says little about the line."""
    n = F.size(line_words)
    marks = sum(F.length(line) - F.length(F.replace(line, F.lit(m), F.lit(""))) for m in ("!!", "??")) / 2
    separators = count_of(line, SEPARATORS)
    # phrases without their first letter, which may be a capital (lower() costs more than all these
    # searches); each count is guarded by a search that most lines end at
    return ((line.rlike(f"[{SYMBOLS}]") & (count_of(line, SYMBOLS) > max_symbols * F.length(line)))
            | (line.rlike("!!|\\?\\?") & (marks > max_marks * n))
            | (line.rlike(f"[{SEPARATORS}]") & (separators >= 3) & (separators > max_separators * n))
            # a line has two words more than windows at most, so few windows are few words
            | ((n >= long_line) & (F.size(F.array_distinct(line_words)) < min_unique * (n - 2) + 3)
               & (F.size(F.array_distinct(gram_hashes(line_words, 3))) < min_unique * (n - 2)))
            | ((n <= phrase_line) & reduce(or_, (line.contains(p[1:]) for p in BOILERPLATE))))


def clean_lines(docs: DataFrame, text: str = "text", max_loss: float = 0.5, **rules) -> DataFrame:
    """`docs` plus struct `line_rules`: cleaned (the text without lines that fail and without later
    copies of a line), n_lines, n_kept_lines, n_dup_lines, chars (characters in words), lost_chars
    (those taken out) and loses_too_much (more than `max_loss` of them).

    A text in which no line fails or repeats is returned as it is. Null and empty texts give
    cleaned "", no loss. Rows are treated one by one: repeated rows give repeated results, and
    other columns pass through whatever their names, except one called line_rules, which is replaced."""
    # arrays are columns of their own, as a field of a struct would be worked out again at each use
    lines, kept, cleaned, chars = fresh(docs.columns, "lines", "kept", "cleaned", "chars")
    body = F.coalesce(F.col(text), F.lit(""))
    solid = lambda c: F.length(without(c, SPACES))
    lost = F.col(chars) - solid(F.col(cleaned))
    return (
        docs.withColumn(lines, F.filter(F.split(body, "\n", -1), has_word))
        .withColumn(kept, F.array_distinct(F.transform(F.filter(
            F.transform(lines, lambda x: F.struct(x.alias("line"), words(x).alias("words"))),
            lambda x: ~line_fails(x["line"], x["words"], **rules)), lambda x: x["line"])))
        .withColumn(cleaned, F.when(F.size(kept) == F.size(lines), body).otherwise(F.array_join(kept, "\n")))
        .withColumn(chars, solid(body))
        .withColumn("line_rules", F.struct(
            F.col(cleaned).alias("cleaned"), F.size(lines).alias("n_lines"), F.size(kept).alias("n_kept_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.col(chars).alias("chars"), lost.cast("long").alias("lost_chars"),
            (lost > max_loss * F.col(chars)).alias("loses_too_much")))
        .drop(lines, kept, cleaned, chars))


def judge(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat: float = 0.5,
          max_loss: float = 0.5, **rules) -> DataFrame:
    """`docs` plus struct `quality`: the counts n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed (too few words, or too many inside repeated 3-word windows),
    kept (not base_failed and the line rules leave enough), cleaned, n_lines, n_kept_lines, lost_chars.

    A column called quality is replaced. A null or empty text has no words: base_failed. See clean_lines for lines and other columns."""
    w, hashes, repeated, n_words = fresh(docs.columns, "words", "hashes", "repeated", "n_words")
    body = F.coalesce(F.col(text), F.lit(""))
    failed = (F.col(n_words) < min_words) | (100 * F.col(repeated) > 100 * max_repeat * F.col(n_words))
    return (
        clean_lines(docs.withColumn(w, words(body)), text, max_loss, **rules)
        .withColumn(hashes, gram_hashes(F.col(w), 3))
        .withColumn(repeated, repeat_words(F.col(hashes))).withColumn(n_words, F.size(w))
        .withColumn("quality", F.struct(
            F.col(n_words).cast("long").alias("n_words"), F.col("line_rules.chars").cast("long").alias("word_chars"),
            count_of(body, SYMBOLS).cast("long").alias("n_symbols"),
            F.col("line_rules.n_dup_lines").cast("long").alias("n_dup_lines"),
            F.col(repeated).cast("long").alias("n_repeat_words"), failed.alias("base_failed"),
            (~failed & ~F.col("line_rules.loses_too_much")).alias("kept"),
            "line_rules.cleaned", "line_rules.n_lines", "line_rules.n_kept_lines", "line_rules.lost_chars"))
        .drop("line_rules", w, hashes, repeated, n_words))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_kept_lines", "lost_chars")])


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, kept ones lose the lines that failed (n_chars follows). Null
    and empty texts have no words and go; repeated rows are judged each for themselves, with one result."""
    (row,) = fresh(docs.columns, "row")
    # one row through explode: a filter cannot move below it and work the rules out twice
    judged = judge(docs).select(*[c for c in docs.columns if c not in ("text", "n_chars")],
                                F.explode(F.array("quality")).alias(row)).where(f"`{row}`.kept")
    text = F.col(f"`{row}`.cleaned")
    given = {"text": text, "n_chars": F.length(text).cast("long")}
    return judged.select(*[given[c].alias(c) if c in given else F.col(f"`{c}`") for c in docs.columns])
