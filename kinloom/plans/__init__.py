"""Queries over the given tables."""

from importlib import import_module

MODULES = ["scalars", "register", "relational", "importing_checks", "linkage", "merging", "family_graph", "pages"]


def load_queries() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
