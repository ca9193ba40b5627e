"""Registered queries; ``load`` imports every module that registers some."""

import importlib

MODULES = ("evidence", "graph", "temporal", "text", "writes", "served")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
