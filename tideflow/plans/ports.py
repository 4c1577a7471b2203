"""Port declarations and what a processor sees at an input port."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ProcessorDefinitionError


class Movement(Enum):
    UNDEFINED = "undefined"
    ONE_TO_ONE = "one_to_one"
    SCATTER_GATHER = "scatter_gather"
    BROADCAST = "broadcast"


@dataclass(frozen=True)
class InputPort:
    name: str
    movement: Movement = Movement.UNDEFINED
    #: Order of the values inside a key's group, ascending (``-F.col("v")`` for descending numbers); SCATTER_GATHER only.
    order_by: tuple[Column | str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "order_by", tuple(self.order_by))
        if self.movement is Movement.UNDEFINED:
            raise ProcessorDefinitionError(f"port {self.name}: the movement is undefined")
        if self.order_by and self.movement is not Movement.SCATTER_GATHER:
            raise ProcessorDefinitionError(f"port {self.name}: only a SCATTER_GATHER port orders values")


@dataclass(frozen=True)
class OutputPort:
    name: str
    key: tuple[str, ...] = ()
    #: DDL of the port's columns; needed by processors of opaque code only.
    schema: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "key", (self.key,) if isinstance(self.key, str) else tuple(self.key))

    @property
    def has_key(self) -> bool:
        return bool(self.key)


@dataclass
class Grouped:
    """What a SCATTER_GATHER port delivers: rows, their key and the order inside a group.

    Nothing is shuffled until one of the methods is used, so Spark can combine before the
    exchange and share one exchange between ports that read the same source.
    """

    df: DataFrame
    key: tuple[str, ...]
    order_by: tuple[Column | str, ...] = ()
    partitions: int | None = None
    _renamed: dict = field(default_factory=dict, repr=False)

    def agg(self, **aggregates: Column) -> DataFrame:
        return self.df.groupBy(*self.key).agg(*[c.alias(n) for n, c in aggregates.items()])

    def values(self, name: str = "values") -> DataFrame:
        """Key and array of value structs; sorted if the port has an order."""
        rest = [c for c in self.df.columns if c not in self.key]
        if not self.order_by:
            return self.df.groupBy(*self.key).agg(F.collect_list(F.struct(*rest)).alias(name))
        order = [F.col(c) if isinstance(c, str) else c for c in self.order_by]
        item = F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("v"))
        return self.df.groupBy(*self.key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name))

    def sorted_partitions(self, n: int | None = None) -> DataFrame:
        """Rows dealt by key and sorted by key, then by the port's order."""
        n = n or self.partitions
        dealt = self.df.repartition(n, *self.key) if n else self.df.repartition(*self.key)
        return dealt.sortWithinPartitions(*self.key, *self.order_by)

    def apply(self, fn: Callable, schema: str) -> DataFrame:
        """Opaque code per group of Arrow data."""
        return self.df.groupBy(*self.key).applyInArrow(fn, schema)

    def join(self, other: Grouped, how: str = "inner") -> DataFrame:
        """Co-group of two ports as a join on their keys, whatever the key columns are called."""
        if len(self.key) != len(other.key):
            raise ProcessorDefinitionError("the keys of joined ports differ in length")
        right = other.df
        for mine, theirs in zip(self.key, other.key, strict=True):
            right = right.withColumnRenamed(theirs, mine)
        return self.df.join(right, list(self.key), how)


def same_schema(frames: Sequence[DataFrame]) -> bool:
    return len({tuple(f.dtypes) for f in frames}) <= 1
