"""Path, language, commit-subject and token functions as plain column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def extension(path: Column) -> Column:
    """Lower-cased suffix of the last path part; a leading run of dots is not a suffix."""
    base = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def lang_of_ext(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.LANG_BY_EXT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit(""))


def path_lang(path: Column) -> Column:
    return lang_of_ext(extension(path))


def wanted(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    base = F.substring_index(path, "/", -1)
    return (~F.arrays_overlap(dirs, _strings(K.EXCLUDED_DIRS))
            & ~base.contains(".min.") & ~base.endswith(".lock")
            & (base != "package-lock.json"))


def excluded_path(text: Column) -> Column:
    return text.rlike(K.EXCLUDED_PATH_PATTERN)


def is_code_lang(lang: Column) -> Column:
    return F.coalesce(lang.isin(K.CODE_LANGS), F.lit(False))


def analysable(repo: Column, path: Column, lang: Column, symbol: Column,
               text_len: Column, min_len: int = 0) -> Column:
    """Chunks that take part in duplicate mining; shorter ones than `min_len` do not."""
    return (is_code_lang(lang) & (text_len >= min_len)
            & (F.coalesce(symbol, F.lit("")) != "")
            & ~excluded_path(F.concat_ws("/", repo, path)))


def indexable_change(status: Column, path: Column) -> Column:
    """A changed file that can carry a positive label (bare path, not repo/path)."""
    return ((status != "D") & wanted(path) & (path_lang(path) != "")
            & ~excluded_path(path))


def clean_query(subject: Column, min_chars: int = 1) -> Column:
    """Commit subject without its pull-request suffix; NULL when it describes nothing or is shorter
    than `min_chars`."""
    stripped = strip(F.regexp_replace(subject, "(?U)" + K.PR_SUFFIX_PATTERN, ""))
    noise = stripped.rlike(K.NOISE_SUBJECT_PATTERN) | (F.length(stripped) < min_chars)
    return F.when(~noise, stripped)


def strip(text: Column) -> Column:
    """Unicode-aware trim of both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def file_key(repo: Column, path: Column) -> Column:
    return F.concat(repo, F.lit("/"), path)


def location(repo: Column, path: Column, line: Column) -> Column:
    return F.concat(repo, F.lit("/"), path, F.lit(":"), line.cast("string"))


def embed_text(repo: Column, path: Column, text: Column, max_chars: int | None = None) -> Column:
    """What a chunk is embedded as; `max_chars` is what of the text a model reads."""
    return F.concat(repo, F.lit("/"), path, F.lit("\n"), text if max_chars is None else F.substring(text, 1, max_chars))


def text_hash(text: Column, model: str = K.MODEL_NAME) -> Column:
    """32-byte cache key of one embedding input."""
    return F.unhex(F.sha2(F.concat(F.lit(model + "\0"), text), 256))


def snippet(text: Column, lines: int = 25) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n")


def tokens(text: Column) -> Column:
    """Distinct lower-cased identifier parts without stop words."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), K.CAMEL_PATTERN, " ")
    parts = F.split(F.lower(F.regexp_replace(spaced, K.TOKEN_SPLIT_PATTERN, " ")), " ", -1)
    return F.array_except(F.filter(parts, lambda t: F.length(t) > 1), _strings(K.STOPWORDS))


def overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the text's tokens that the query also has."""
    hit = F.size(F.array_intersect(query_tokens, text_tokens))
    return F.coalesce(F.try_divide(hit, F.size(text_tokens)), F.lit(0.0))


def date_of_ts(ts: Column) -> Column:
    """UTC date of epoch seconds, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"),
                      F.floor(ts / F.lit(86400)).cast("int")).cast("string")
