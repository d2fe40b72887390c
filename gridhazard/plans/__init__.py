"""Runnable queries: each plan module wires operators to the given tables."""

from gridhazard.plans import catalogue, currents, economics, extremes, fields, files, impact, sensors, topology  # noqa: F401
from gridhazard.plans.registry import REGISTRY  # noqa: F401
