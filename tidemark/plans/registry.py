"""Every registered query, and the DuckDB SQL it is held against."""

from __future__ import annotations

from . import entity_queries, feed_queries, text_queries

FLAGSHIP = "url_canonicalize"
QUERIES: dict = {**entity_queries.QUERIES, **text_queries.QUERIES, **feed_queries.QUERIES}
ORACLE_SQL: dict = {**entity_queries.ORACLE_SQL, **text_queries.ORACLE_SQL, **feed_queries.ORACLE_SQL}
