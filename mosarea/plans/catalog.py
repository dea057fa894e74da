"""All registered queries."""

from mosarea.plans import catalog_basic, catalog_frame, catalog_model, catalog_sources, catalog_validate  # noqa: F401
from mosarea.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
