"""Registered queries, by family."""

import importlib
import pkgutil

from tablewright.plans.base import QUERIES, SQL


def load() -> None:
    """Import every module of plans, which registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


__all__ = ["QUERIES", "SQL", "load"]
