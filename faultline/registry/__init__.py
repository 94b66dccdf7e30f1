"""All registered queries."""

from faultline.registry.catalog import ORACLE, QUERIES

from faultline.registry import change_queries, clean_queries, feature_queries, graph_queries, history_queries, label_queries, plan_queries, result_queries, source_queries, text_queries  # noqa: F401  isort: skip

__all__ = ["ORACLE", "QUERIES"]
