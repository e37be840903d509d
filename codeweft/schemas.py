"""Explicit schemas of the stored tables and the accepted inputs."""
from __future__ import annotations

CHUNKS = ("id string, repo string, path string, start_line int, end_line int, "
          "symbol string, lang string, text string, embedding array<float>")
REPOS = "repo string, commit_sha string, indexed_at string"
CALL_REPOS = REPOS + ", tool string"
META = "key string, value string"
VECTOR_CACHE = "hash binary, embedding array<float>"
SYMBOLS = ("id string, repo string, scip_symbol string, name string, kind string, "
           "path string, start_line int, end_line int")
REFS = ("symbol_id string, repo string, path string, line int, "
        "enclosing_symbol_id string, role string")
LEDGER = "a string, b string, n long, max_sim double, example string"
REPO_LISTING = "name string, size long, fork boolean, archived boolean"

_OCCURRENCE = ("struct<range: array<int>, symbol: string, symbol_roles: int, "
               "enclosing_range: array<int>>")
_RELATION = ("struct<symbol: string, is_implementation: boolean, is_reference: boolean, "
             "is_type_definition: boolean>")
_SYMBOL_INFO = ("struct<symbol: string, kind: int, display_name: string, "
                f"relationships: array<{_RELATION}>>")
SCIP_DOCUMENT = (f"relative_path string, symbols array<{_SYMBOL_INFO}>, "
                 f"occurrences array<{_OCCURRENCE}>")
SCIP_INDEX = ("metadata struct<tool_info: struct<name: string, version: string>, "
              "project_root: string>, "
              f"documents array<struct<relative_path: string, symbols: array<{_SYMBOL_INFO}>, "
              f"occurrences: array<{_OCCURRENCE}>>>")

_CANDIDATE = ("struct<repo: string, path: string, start_line: int, end_line: int, "
              "symbol: string, lang: string, text_len: int, distance: double, label: int>")
GROUPS = (f"repo string, sha string, ts long, query string, n_pos int, "
          f"candidates array<{_CANDIDATE}>")
