"""Queries over the given tables, one module per operator family."""

import importlib

MODULES = ["tables", "grouped", "ordered_series", "pixels", "curve_shapes", "gene_tables", "greedy"]


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    for name in MODULES:
        importlib.import_module(f"kymora.plans.{name}")
