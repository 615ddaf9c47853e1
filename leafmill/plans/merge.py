"""Keyed merges of document tables: replace, keep, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the order; one aggregation, no window."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """Old rows without a new one, and the last new row of each key."""
    fresh = latest(new, key, *order)
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def skip_known(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """Old rows, and the first new row of each key that is not there."""
    return old.unionByName(first(new, key, *order).join(old.select(key), key, "left_anti"))


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def missing(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keys that are not there."""
    return keys.select(key).distinct().join(old.select(key), key, "left_anti")
