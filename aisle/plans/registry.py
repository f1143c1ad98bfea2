"""Registration of queries and their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aisle.sources.standins import STANDINS, Tables, duck_text, references

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, helpers: dict[str, str] | None = None) -> str:
    """Prefix the SQL with the views it names, each after the ones it needs."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for ref in references(name):
            need(ref)
        ordered.append(name)

    body = sql.strip()
    for name in STANDINS:
        if re.search(rf"\b{name}\b", body):
            need(name)
    ctes = [f"{name} AS ({duck_text(name)}\n)" for name in ordered]
    if body[:5].upper() == "WITH ":
        own = body[5:]
        if own[:10].upper() == "RECURSIVE ":
            return "WITH RECURSIVE " + ",\n".join([*ctes, own[10:]])
        return "WITH " + ",\n".join([*ctes, own])
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def query(name: str, sql: str | None = None):
    """Register a plan taking ``Tables``; ``sql`` is the DuckDB text that must agree with it."""

    def add(plan: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = lambda spark, directory: plan(Tables(spark, directory))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return plan

    return add
