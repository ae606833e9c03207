"""The registered queries and the SQL that each is checked against."""

from .plans import array_queries, edit_queries, geometry_queries, lifecycle_queries, normaliser_queries, relational_queries, render_queries, review_queries, screen_queries, state_queries, text_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
