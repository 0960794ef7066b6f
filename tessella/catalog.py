"""All queries: importing this module imports every plan."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
PLANS = ("scans", "projections", "joining", "aggregates", "series", "ranking", "scalars", "convergence", "drift", "market", "returns", "graphs", "evidence", "streams", "normalisers", "modes", "source_modes", "source_normalisers", "source_evidence", "readers", "beliefs", "macro")

for _name in PLANS:
    importlib.import_module(f"tessella.plans.{_name}")
