"""All registered queries and the SQL each is held against, by topic."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("audit", "contrast", "vectors", "design", "records", "models", "reconstruct", "study", "resamples", "faults")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _topic in TOPICS:
    _module = import_module(f"{__package__}.plans.{_topic}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
