"""All queries of the usage engine."""

from . import cube_queries, report_queries, source_queries, stream_queries, usage_queries
from .registry import ORACLES, QUERIES

__all__ = ["cube_queries", "oracles", "queries", "report_queries", "source_queries", "stream_queries", "usage_queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
