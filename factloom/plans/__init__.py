"""Bindings of operators to the tables of a data directory, with equivalent SQL."""

from factloom.plans import capture, facts, graphs, rewrites, staged, streams, structure, symbols  # noqa: F401  (they register their queries)
from factloom.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
