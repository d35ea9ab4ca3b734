"""Registered queries, one module per section of the inventory."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every plan module once and return the registry."""
    registry = importlib.import_module("tickloom.plans.registry")
    for info in pkgutil.iter_modules(__path__):
        if info.name != "registry":
            importlib.import_module(f"{__name__}.{info.name}")
    return registry
