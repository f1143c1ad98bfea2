"""Registered queries: each pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

from aisle.plans.registry import ORACLES, PLANS

MODULES = ["stores", "customers", "products", "supply_chain", "employees", "space", "forecasting", "meters", "baskets", "feeds", "listings"]


def load() -> None:
    for name in MODULES:
        import_module(f"aisle.plans.{name}")


def queries():
    load()
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)
