"""Runnable queries, grouped by subject."""

from __future__ import annotations

import importlib

GROUPS = ["traffic", "urls", "quality", "flows", "vectors", "policy", "similarity", "learn", "streams"]


def load_catalog():
    from tidewatch.plans.registry import CATALOG

    for group in GROUPS:
        importlib.import_module(f"tidewatch.plans.{group}")
    return CATALOG
