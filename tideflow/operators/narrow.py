"""Operators without a shuffle: each output row depends on one input row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*columns)


def filter_rows(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.where(predicate)


def flat_map(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of the array ``items``, beside the kept columns."""
    return df.select(*keep, F.explode(items).alias(name))


def unite(*sources: DataFrame) -> DataFrame:
    """UNION ALL by column name; a source named twice counts twice."""
    if not sources:
        raise ValueError("unite needs at least one source")
    return reduce(DataFrame.unionByName, sources)


def split(df: DataFrame, routes: Mapping[str, Column]) -> dict[str, DataFrame]:
    """One DataFrame per named predicate; rows that match several go to each, rows that match none to no one."""
    return {name: df.where(predicate) for name, predicate in routes.items()}


def demultiplex(df: DataFrame, routes: Mapping[str, Column], port: str = "port") -> DataFrame:
    """First matching route's name as a column; rows without a route are dropped."""
    name = F.coalesce(*[F.when(predicate, F.lit(label)) for label, predicate in routes.items()])
    return df.withColumn(port, name).where(F.col(port).isNotNull())


def gather(df: DataFrame) -> DataFrame:
    """All rows in one partition, as a single-writer sink needs them."""
    return df.coalesce(1)


def throttle(df: DataFrame, n: int) -> DataFrame:
    """At most n tasks at once for what follows without a shuffle."""
    if n < 1:
        raise ValueError("a concurrency limit is 1 or more")
    return df.coalesce(n)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Opaque code per Arrow batch: zero or more batches out for each batch in."""

    def each(batches):
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(each, schema)
