"""All registered queries of the light-curve engine and their SQL."""

from __future__ import annotations

from . import curves, forecasts, scoring, streams, tables, training  # noqa: F401
from .base import ORACLE_SQL, QUERIES

FLAGSHIP = "prefix_causal_colours"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
