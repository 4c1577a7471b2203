"""Relational and dataflow operators: pure functions from DataFrames to DataFrames."""

from .grouped import (
    cogroup, cogroup_apply, distinct_keys, fold_by_key, group_values, per_partition, reduce_by_key,
    running, shuffle, top_k, value_sort,
)
from .joins import (
    anti_join, broadcast_join, checked_broadcast, duplicate, lookup_join, outer_join, semi_join,
    sort_join, with_scalars,
)
from .narrow import demultiplex, filter_rows, flat_map, gather, project, split, throttle, unite

__all__ = [
    "anti_join", "broadcast_join", "checked_broadcast", "cogroup", "cogroup_apply", "demultiplex",
    "distinct_keys", "duplicate", "filter_rows", "flat_map", "fold_by_key", "gather", "group_values",
    "lookup_join", "outer_join", "per_partition", "project", "reduce_by_key", "running", "semi_join",
    "shuffle", "sort_join", "split", "throttle", "top_k", "unite", "value_sort", "with_scalars",
]
