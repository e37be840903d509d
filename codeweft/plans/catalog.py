"""Every registered query with the SQL that must give the same rows."""
from __future__ import annotations

from . import graph_queries, index_queries, ranking_queries, search_queries, text_queries

ALL = {name: pair for module in (search_queries, text_queries, graph_queries, index_queries, ranking_queries)
       for name, pair in module.QUERIES.items()}
