"""Imports every plan module, which registers its queries."""

from __future__ import annotations

import importlib

MODULES = ["tables", "columns", "joins", "aggregates", "scalars", "encoders", "metrics", "modelling", "images"]


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"trialweave.plans.{module}")
