"""Named queries: importing this package registers all of them."""

from kiln.plans import (certified, evaluation, event_windows, extras, flagship, point_streams,  # noqa: F401
                        projections, recommendation, reports, scans, splits, training)
from kiln.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
