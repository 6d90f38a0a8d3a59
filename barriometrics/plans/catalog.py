"""Every registered query, by importing the modules that register them."""

from barriometrics.plans import queries_listings, queries_metrics, queries_models  # noqa: F401
from barriometrics.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
