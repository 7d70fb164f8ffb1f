"""All queries: importing the modules fills the registry."""

from workload import analyses, facts, files, models, panels, places, survey, tables  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
