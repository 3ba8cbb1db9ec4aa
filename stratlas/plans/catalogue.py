"""All queries of the library on the driver's tables, and SQL that states the same results.

Each query is one operator (or a chain of them) applied to a whole table that
stands in for the atlas data; the modules beside this one register them.
"""

from __future__ import annotations

import importlib

from stratlas.plans.registry import ORACLES, QUERIES

for _module in ("spatial", "trees", "measurements", "anchors", "stored", "patches"):
    importlib.import_module(f"stratlas.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
