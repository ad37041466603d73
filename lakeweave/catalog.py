"""The queries of the engine's own operators and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from lakeweave import plans
from lakeweave.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    importlib.import_module(f"lakeweave.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
