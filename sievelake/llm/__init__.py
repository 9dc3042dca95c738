"""Operators of a training-data pipeline, and the queries that apply them."""

from sievelake.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
