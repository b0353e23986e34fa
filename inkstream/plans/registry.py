"""All registered queries of the library, and the SQL that gives the same rows."""

from inkstream.plans import adapter_queries, article_queries, connector_queries, index_queries, markup_queries, page_queries, parsed_queries, scalar_queries, store_queries  # noqa: F401
from inkstream.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
