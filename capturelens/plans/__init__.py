"""Named queries over the given tables."""

from . import (  # noqa: F401
    queries_sampling,
    queries_raster,
    queries_reports,
    queries_scalar,
    queries_geometry,
    queries_study,
    queries_tables,
    queries_text,
    queries_time,
)
from .registry import ORACLES, QUERIES, Bound

__all__ = ["ORACLES", "QUERIES", "Bound"]
