"""Named queries over the driver tables, with their SQL."""

from heronflow.plans import feature_queries, history_queries, log_queries, ml_queries, ops_queries, profile_queries, scoring, sketch_queries, source_queries, stats_queries, stream_queries
from heronflow.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "feature_queries", "history_queries", "log_queries", "ml_queries", "ops_queries", "profile_queries", "scoring", "sketch_queries", "source_queries", "stats_queries", "stream_queries"]
