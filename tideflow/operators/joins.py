"""Joins. A side is broadcast only when the optimizer's size of it is within a limit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouped import Keys, _keys

BROADCAST_LIMIT = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a DataFrame's size; after an explode or opaque code it may be too small."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast if the side is known to be small; else leave the choice to the planner, which shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def _on(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool):
    if not null_safe:
        return keys
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])


def broadcast_join(probe: DataFrame, build: DataFrame, key: Keys, how: str = "inner", *, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hash join with a small build side; beyond ``limit`` bytes it is a shuffled join with the same rows."""
    return probe.join(checked_broadcast(build, limit), _keys(key), how)


def lookup_join(probe: DataFrame, build: DataFrame, key: Keys, first_by: Sequence[str], *, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Inner join with the first build row of each key in the order ``first_by``."""
    keys = _keys(key)
    rest = [c for c in build.columns if c not in keys]
    order = F.struct(*first_by)
    one = build.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(*keys, "_first.*")
    return probe.join(checked_broadcast(one, limit), keys)


def sort_join(left: DataFrame, right: DataFrame, key: Keys, how: str = "inner", *, null_safe: bool = False) -> DataFrame:
    """Sort-merge join, m:n; adaptive execution splits skewed partitions."""
    return _joined(left, right, _keys(key), how, null_safe, "merge")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str, null_safe: bool, hint: str | None = None) -> DataFrame:
    hinted = right.hint(hint) if hint else right
    if not null_safe:
        return left.join(hinted, keys, how)
    joined = left.join(hinted, _on(left, right, keys, True), how)
    if how in ("left_semi", "left_anti"):
        return joined
    rest = [right[c] for c in right.columns if c not in keys]
    head = [F.coalesce(left[k], right[k]).alias(k) for k in keys]
    return joined.select(*head, *[left[c] for c in left.columns if c not in keys], *rest)


def outer_join(left: DataFrame, right: DataFrame, key: Keys, side: str = "full", *, null_safe: bool = False) -> DataFrame:
    """Outer join; the planner chooses between a small side's broadcast and a shuffle. ``sort_join`` asks for sort-merge."""
    if side not in ("left", "right", "full"):
        raise ValueError("side is left, right or full")
    return _joined(left, right, _keys(key), side, null_safe)


def semi_join(left: DataFrame, right: DataFrame, key: Keys, *, null_safe: bool = False) -> DataFrame:
    return _joined(left, right, _keys(key), "left_semi", null_safe)


def anti_join(left: DataFrame, right: DataFrame, key: Keys, *, null_safe: bool = False) -> DataFrame:
    return _joined(left, right, _keys(key), "left_anti", null_safe)


def duplicate(df: DataFrame, task_count: int, id_name: str = "task_id") -> DataFrame:
    """Every row once for each of task_count tasks. ``task_count`` is a parameter, so this is a bounded flat map."""
    if task_count < 0:
        raise ValueError("task_count is 0 or more")
    ids = F.sequence(F.lit(0), F.lit(task_count - 1)) if task_count else F.array().cast("array<int>")
    return df.select(F.explode(ids.cast("array<bigint>")).alias(id_name), *df.columns)


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Beside every row, the columns of a one-row DataFrame (a global aggregate).

    As for a scalar subquery, no row means nulls, and more than one row is an error when the result is computed.
    """
    one = scalars.agg(F.count("*").alias("_rows"), F.first(F.struct("*")).alias("_row"))
    single = F.when(F.col("_rows") <= 1, True).otherwise(F.raise_error(F.lit("the scalar side has more than one row")).cast("boolean"))
    return df.join(F.broadcast(one.where(single).select("_row.*")))
