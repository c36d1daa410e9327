"""Operators for preparing training text. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

_MODULES = ("neardup", "toxicity", "linededup", "decontam", "packing", "sharding", "langid", "pii", "licenses", "media")


def _each(what: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        found.update(getattr(importlib.import_module(f"partylens.llm.{name}"), what))
    return found


def queries() -> dict:
    return _each("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _each("SQL")
