"""All queries of the merge library by name, and their DuckDB SQL."""

from tributary.plans import more_queries  # noqa: F401  (registers its queries)
from tributary.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
