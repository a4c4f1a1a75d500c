"""Joins of many rows with one row for each key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], count: str, most: int = 10_000) -> DataFrame:
    """The inner join on ``keys``; ``one`` has a row for each key, with ``count``, the number of its rows in ``many``.

    Keys with more than one in ``most`` of all rows, fewer than ``most`` of them whatever
    the input, are broadcast to the rows; the others are joined by a shuffle. ``many`` is
    read twice, so it should be a written table. Null keys join nothing.
    """
    total = one.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(one.where(F.col(count) * most > total).drop(count))
    cold = one.where(F.col(count) * most <= total).drop(count)
    rare = many.join(hot.select(*keys), keys, "left_anti")
    return many.join(hot, keys).unionByName(rare.join(cold, keys))
