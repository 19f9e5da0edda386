"""All queries of the core with their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("caption_queries", "annotation_queries", "record_queries", "claim_queries")


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"claimframe.plans.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
