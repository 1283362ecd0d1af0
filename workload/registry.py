"""All registered queries."""

from __future__ import annotations

import importlib

from lodestone.session import configure

MODULES = ["prep", "retrieval", "words", "users", "streams", "flows"]


def _all(attribute: str) -> dict:
    out = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"workload.{name}"), attribute))
    return out


def queries() -> dict:
    def bound(fn):
        return lambda spark, d: fn(configure(spark), d)

    return {name: bound(fn) for name, fn in _all("QUERIES").items()}


def oracles() -> dict:
    return _all("ORACLES")
