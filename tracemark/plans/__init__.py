"""Registered queries, one module per domain."""

from __future__ import annotations

import importlib

MODULES = (
    "similarity",
    "catalog",
    "reporting",
    "text",
    "frames",
    "models",
    "exports",
)


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"tracemark.plans.{module}")
