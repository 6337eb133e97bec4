"""Queries over the driver's tables. Importing this package fills the registry."""

from quellgraph.plans import found, measures, response, spread, structure  # noqa: F401
from quellgraph.plans.registry import ORACLES, QUERIES  # noqa: F401
