"""Registered queries: each module binds one family of operators to the given tables."""

from importlib import import_module

FAMILIES = ("evaluation", "bootstrap", "prep", "assoc", "ordering", "features", "monitoring", "modelling", "champion")


def load() -> None:
    for name in FAMILIES:
        import_module(f"ordinalis.plans.{name}")
