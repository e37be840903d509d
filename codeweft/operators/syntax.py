"""Definition spans of one file, from whatever parser the worker has.

The full grammar pack is used where it is installed. Without it Python files are read
with the standard library and every other language falls back to line windows, which is
what a missing grammar means everywhere.
"""
from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .. import constants as K

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                             ("symbol", pa.string())]))
_grammars: dict = {}


def _fits(lines: int, size: int) -> bool:
    return lines <= K.MAX_CHUNK_LINES and size <= K.MAX_CHUNK_BYTES


def _grammar(lang: str):
    if lang not in _grammars:
        try:
            from tree_sitter_language_pack import get_parser
            _grammars[lang] = get_parser(lang)
        except Exception:
            _grammars[lang] = None
    return _grammars[lang]


def _label(node) -> str:
    named = node.child_by_field_name("name")
    options = [named] if named is not None else (
        c if "identifier" in c.type else c.child_by_field_name("name")
        for c in node.children)
    found = next((c for c in options if c is not None), None)
    return "" if found is None else found.text.decode("utf-8", "replace")[:120]


def _tree_spans(parser, text: str, lang: str):
    wanted, todo = set(K.CAPTURE[lang]), [parser.parse(text.encode("utf-8", "replace")).root_node]
    while todo:
        node = todo.pop()
        first, last = node.start_point[0], node.end_point[0]
        if node.type in wanted and _fits(last - first + 1, node.end_byte - node.start_byte):
            yield first, last, _label(node)
        else:
            todo.extend(node.children)


# Per kind of node the fields that hold statements; most kinds have none.
_INNER: dict = {}


def _statements(node):
    """Statements directly inside a node; definitions cannot hide in expressions."""
    fields = _INNER.get(type(node))
    if fields is None:
        fields = _INNER[type(node)] = [f for f in ("body", "orelse", "finalbody", "handlers", "cases") if f in node._fields]
    for field in fields:
        inner = getattr(node, field, None)
        if isinstance(inner, list):
            yield from inner


def _python_spans(text: str):
    offsets = [0]
    for line in text.encode("utf-8", "replace").split(b"\n"):
        offsets.append(offsets[-1] + len(line) + 1)
    todo = [ast.parse(text)]
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            end = offsets[node.end_lineno - 1] + node.end_col_offset
            heads = [(node.lineno, node.col_offset)]
            if node.decorator_list:
                first = node.decorator_list[0]
                heads.insert(0, (first.lineno, max(first.col_offset - 1, 0)))
            for line, col in heads:
                if _fits(node.end_lineno - line + 1, end - offsets[line - 1] - col):
                    yield line - 1, node.end_lineno - 1, node.name[:120]
                    break
            else:
                todo.extend(_statements(node))
        elif type(node) not in _INNER or _INNER[type(node)]:
            todo.extend(_statements(node))


def spans_of(text: str | None, lang: str | None):
    """Sorted (start, end, symbol) spans, 0-based inclusive; None when nothing can parse it."""
    if text is None or lang not in K.CAPTURE:
        return None
    parser = _grammar(lang)
    try:
        if parser is not None:
            found = _tree_spans(parser, text, lang)
        elif lang == "python":
            found = _python_spans(text)
        else:
            return None
        return [{"start": s, "end": e, "symbol": n} for s, e, n in sorted(found)]
    except (SyntaxError, ValueError, RecursionError):
        return None


@F.arrow_udf(from_arrow_type(_SPANS))
def _spans(text: pa.Array, lang: pa.Array) -> pa.Array:
    return pa.array([spans_of(t.as_py(), n.as_py()) for t, n in zip(text, lang)], type=_SPANS)


def syntax_spans(text: Column, lang: Column) -> Column:
    """Spans column; texts without a capture set are not sent to Python."""
    parsable = lang.isin(list(K.CAPTURE))
    return _spans(F.when(parsable, text), F.when(parsable, lang))
