"""All registered queries."""

from fleetgauge.plans import (  # noqa: F401
    clusters,
    history,
    jobs,
    monitors,
    processes,
    selection,
    snapshots,
    streams,
    timelines,
    trips,
)
from fleetgauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
