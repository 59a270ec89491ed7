"""Queries over the given tables, each next to the SQL it is compared with."""

import importlib

MODULES = ("profiling", "relations", "defect_checks", "privacy", "generation", "validity", "cases", "reporting", "delivery")


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"checks.{module}")
