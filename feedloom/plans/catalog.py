"""All registered queries."""

from feedloom.plans import queries_content, queries_feed, queries_reports, queries_store  # noqa: F401
from feedloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
