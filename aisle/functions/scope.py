"""Row scope and listing filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between_dates(df: DataFrame, col: str, start, end) -> DataFrame:
    return df.where(F.col(col).between(F.lit(start), F.lit(end)))


def scope_stores(
    df: DataFrame, stores: Iterable[int] | DataFrame | None, col: str = "store_id"
) -> DataFrame:
    """None keeps all rows, an empty list keeps none.

    A list, which a caller has typed or been granted, is a pushed-down IN at any length: Spark turns long
    ones into a hash set and pushes their range. A permission table is a left-semi join whose strategy
    Spark picks by size.
    """
    if stores is None:
        return df
    if isinstance(stores, DataFrame):
        allowed = stores.select(F.col(stores.columns[0]).alias(col)).distinct()
        return df.join(allowed, col, "left_semi")
    ids = sorted(set(stores))
    return df.where(F.col(col).isin(ids) if ids else F.lit(False))


def effective_scope(
    requested: Iterable[int] | None, authorised: Iterable[int] | None
) -> list[int] | None:
    """Requested and authorised store ids; ``authorised=None`` is an administrator."""
    if authorised is None:
        return None if requested is None else sorted(set(requested))
    if requested is None:
        return sorted(set(authorised))
    return sorted(set(requested) & set(authorised))


def authorised_stores(permissions: DataFrame, user_id: int, is_admin: bool = False) -> DataFrame | None:
    """Store ids a user may read, as a table for ``scope_stores``."""
    if is_admin:
        return None
    return permissions.where(F.col("user_id") == user_id).select("store_id").distinct()


def scope_members(members: DataFrame, events: DataFrame, stores, key: str = "member_id") -> DataFrame:
    """Members seen in at least one authorised store."""
    if stores is None:
        return members
    seen = scope_stores(events, stores).select(F.col("member_id").alias(key)).distinct()
    return members.join(seen, key, "left_semi")


def where_optional(df: DataFrame, **equals) -> DataFrame:
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def keyword_search(df: DataFrame, cols: list[str], keyword: str | None) -> DataFrame:
    """Case-insensitive substring over any of the columns; % and _ stay wildcards, as in ILIKE."""
    if not keyword:
        return df
    hit: Column = F.lit(False)
    for name in cols:
        hit = hit | F.col(name).ilike(f"%{keyword}%")
    return df.where(hit)


def match_or_null(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col).isNull() | (F.col(col) == F.lit(value)))


def targets_item(targets: Column, item: Column, exact: bool = False) -> Column:
    """Item named in a delimited list. Substring match unless ``exact``."""
    if exact:
        return F.array_contains(F.transform(F.split(targets, "[,;]"), lambda part: F.trim(part)), item)
    return targets.contains(item)
