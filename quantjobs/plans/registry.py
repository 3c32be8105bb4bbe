"""All queries of the reference's operators, with their SQL."""

from __future__ import annotations

from importlib import import_module

from quantjobs.plans.fixtures import with_views

MODULES = ("market", "scoring", "portfolio", "ledger", "decisions")


def registered() -> dict:
    """name -> (function of (spark, sf_dir), SQL or None)."""
    out: dict = {}
    for module in MODULES:
        out |= import_module(f"quantjobs.plans.{module}").QUERIES
    return out


def queries() -> dict:
    return {name: f for name, (f, _) in registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in registered().items() if sql}
