"""All registered queries. Importing the modules fills the registry."""

from __future__ import annotations

from fleetpulse.plans import detection, fleet, monitoring, preparation, streams  # noqa: F401
from fleetpulse.plans.registry import QUERIES

__all__ = ["QUERIES"]
