"""Registered queries. Importing the package registers all of them."""

from sievelake.plans import text_queries  # noqa: F401
from sievelake.plans import dedup_queries  # noqa: F401
from sievelake.plans import match_queries  # noqa: F401
from sievelake.plans import gold_queries  # noqa: F401
from sievelake.plans import funnel_queries  # noqa: F401
from sievelake.plans import overlap_queries  # noqa: F401
from sievelake.plans import report_queries  # noqa: F401
from sievelake.plans import decision_queries  # noqa: F401
from sievelake.plans import intake_queries  # noqa: F401
from sievelake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
