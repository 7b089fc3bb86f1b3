"""The registered queries of the sky-tile operators and their SQL."""

from . import cases, extras, grid, measures, pixels  # noqa: F401  (they register themselves)
from .sky import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
