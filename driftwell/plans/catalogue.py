"""The library's queries by name, with their oracles. Importing the modules below registers them."""

from __future__ import annotations

from driftwell.plans import basics, discovery, oracles, vector_queries  # noqa: F401
from driftwell.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "hubs"
