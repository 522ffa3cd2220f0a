"""All registered archive queries and the SQL that checks them."""

from turnlake.plans import archive_queries, ingest_queries, search_queries  # noqa: F401  they register themselves
from turnlake.plans.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
