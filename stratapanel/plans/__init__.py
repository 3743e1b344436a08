"""Query catalogue over the test tables."""

from stratapanel.plans import inference, learning, preparation, statistics  # noqa: F401
from stratapanel.plans.registry import ORACLES, QUERIES
from stratapanel.plans.statistics import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
