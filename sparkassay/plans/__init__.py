"""Named queries over the driver tables, one module per operator family."""

from __future__ import annotations

import importlib

from sparkassay.plans.catalog import ORACLES, QUERIES

FAMILIES = ("stats", "clean", "joins", "metrics", "splits", "text", "nested", "pipelines", "io", "molecules")


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"sparkassay.plans.{family}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
