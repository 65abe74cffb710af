"""All core queries: importing the query modules fills the registry."""

from phrasewerk.plans import graph_queries, rag_queries, text_queries, vector_queries  # noqa: F401
from phrasewerk.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
