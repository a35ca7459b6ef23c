"""All registered checks: importing this module fills ``QUERIES`` and ``ORACLE`` (see ``registry``)."""

from __future__ import annotations

from .registry import ORACLE, QUERIES, petition_table, r, register, rounded, valid, with_ctes  # noqa: F401

# Query modules register themselves on import.
from . import (catalog_queries, catalog_rows, catalog_aggs, catalog_profile, catalog_stats,  # noqa: E402,F401
               catalog_ml, catalog_sources, catalog_score)
