"""All registered queries: importing this module imports the modules that register them."""

from tessera.plans import document_queries, fact_queries, retrieval_queries, rule_queries
from tessera.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "document_queries", "fact_queries", "retrieval_queries", "rule_queries"]
