"""All registered queries, and SQL for their rows."""

from quillgrid.plans import benchmark, content, decisions, exchange, preference, review  # noqa: F401
from quillgrid.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
