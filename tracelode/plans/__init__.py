"""Registered queries: operators over projections of the generic tables, each with the SQL of its oracle."""

from __future__ import annotations

from importlib import import_module

MODULES = ("judgments", "timeline", "responses", "tasks", "audits", "quality", "streams")


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), name).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
