"""Registered queries over the driver tables, each with its SQL oracle."""

from __future__ import annotations

import importlib
import pkgutil

from pactum.workload.registry import ORACLES, QUERIES


def _load_all() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")


def all_queries() -> dict:
    _load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)
