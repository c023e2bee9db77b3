"""Registered queries by theme."""

import importlib

THEMES = ("segments", "relational", "sequence", "text", "measures", "streams", "reports")


def load() -> None:
    """Import every theme, which registers its queries."""
    for name in THEMES:
        importlib.import_module(f"{__name__}.{name}")
