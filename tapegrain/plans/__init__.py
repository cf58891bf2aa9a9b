"""Registered queries by area. Importing the modules fills the catalog."""

from __future__ import annotations

import importlib

from tapegrain.plans.catalog import CATALOG

AREAS = ["windows", "regimes", "joins", "evaluation", "text", "studies", "signals", "streams", "sources", "models", "strategies"]


def load_catalog():
    for area in AREAS:
        importlib.import_module(f"tapegrain.plans.{area}")
    return CATALOG
