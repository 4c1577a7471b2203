"""Operators that bring the rows of a key together."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = str | Sequence[str]


def _keys(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def shuffle(df: DataFrame, key: Keys, partitions: int | None = None, order_by: Sequence[Column | str] = ()) -> DataFrame:
    """Hash-partition by key and sort each partition by key, then by ``order_by``."""
    keys = _keys(key)
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order_by)


def reduce_by_key(df: DataFrame, key: Keys, **aggregates: Column) -> DataFrame:
    """Aggregates per key; Spark combines on the map side before it shuffles."""
    return df.groupBy(*_keys(key)).agg(*[column.alias(name) for name, column in aggregates.items()])


def fold_by_key(df: DataFrame, key: Keys, value: str, init: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Left fold of a key's values in ascending value order, for functions without a built-in aggregate."""
    values = F.array_sort(F.collect_list(value))
    return df.groupBy(*_keys(key)).agg(F.aggregate(values, init, step).alias(name))


def group_values(df: DataFrame, key: Keys, value: Column | str, name: str = "vs") -> DataFrame:
    """A key's values as an array; their order is not promised."""
    return df.groupBy(*_keys(key)).agg(F.collect_list(value).alias(name))


def value_sort(
    df: DataFrame, key: Keys, value: Column | str, name: str = "vs", *, descending: bool = False,
    comparator: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """A key's values as an array in order, or in the order of a comparator column function (negative, 0, positive)."""
    values = F.collect_list(value)
    if comparator is not None:
        ordered = F.array_sort(values, comparator)
    elif descending:
        ordered = F.sort_array(values, asc=False)
    else:
        ordered = F.array_sort(values)
    return df.groupBy(*_keys(key)).agg(ordered.alias(name))


def top_k(df: DataFrame, key: Keys, order_by: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each key. Spark's WindowGroupLimit keeps k rows per key before the shuffle."""
    window = Window.partitionBy(*_keys(key)).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")


def running(df: DataFrame, key: Keys, order_by: Sequence[Column | str], **aggregates: Column) -> DataFrame:
    """Aggregates over a key's rows up to the current one."""
    window = Window.partitionBy(*_keys(key)).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({name: column.over(window) for name, column in aggregates.items()})


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def cogroup(sides: Mapping[str, DataFrame], key: Keys, aggregates: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """N-ary co-group: every side is aggregated on its own, then full-outer joined on the key.

    Each side is combined before the shuffle, so a hot key is one row per map task, and
    the joins find their inputs already partitioned.
    """
    keys = _keys(key)
    out: DataFrame | None = None
    for name, df in sides.items():
        side = reduce_by_key(df, keys, **aggregates[name])
        out = side if out is None else out.join(side, keys, "full")
    if out is None:
        raise ValueError("cogroup needs at least one side")
    return out


def cogroup_apply(left: DataFrame, right: DataFrame, key: Keys, fn: Callable, schema: str) -> DataFrame:
    """Opaque code for both sides' Arrow tables of a key; both must fit in a worker's memory."""
    keys = _keys(key)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)


def per_partition(df: DataFrame, key: Keys, partitions: int, fn: Callable, schema: str, order_by: Sequence[Column | str] = (),
                  ordered: bool = True) -> DataFrame:
    """Opaque code once per hash partition, empty ones included: ``fn`` gets an iterator of Arrow batches, sorted by key unless
    ``ordered`` is false; a fold over them holds one value, however large a key is.

    A relation that the optimizer proves to be empty is not run at all.
    """
    dealt = shuffle(df, key, partitions, order_by) if ordered else df.repartition(partitions, *_keys(key))
    return dealt.mapInArrow(fn, schema)
