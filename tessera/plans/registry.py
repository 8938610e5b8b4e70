"""All registered queries of the library, by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans import catalog_queries, crawl_queries, fusion_queries, index_queries, link_queries, more_queries, stream_queries, table_queries, text_queries

MODULES = [text_queries, table_queries, more_queries, fusion_queries, catalog_queries, index_queries, crawl_queries, stream_queries, link_queries]


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
