"""Queries by name, bound to the tables of a folder."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("training_core", "memory", "code", "texts", "streams", "more", "inventory", "parsed")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), what))
    return out


def core_queries() -> dict:
    return _merged("QUERIES")


def core_sql() -> dict:
    return _merged("SQL")
