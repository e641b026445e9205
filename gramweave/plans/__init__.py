"""Named queries of the engine's operators over a folder of tables, and their SQL."""

from gramweave.plans import entry_queries, geometry_queries, learning_queries, relational_queries  # noqa: F401
from gramweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
