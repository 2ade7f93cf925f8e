"""Everything that is registered."""

from __future__ import annotations

from leadline.checks import generic, modelling, registry, tracking  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
