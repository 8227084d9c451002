"""Operator families as functions from DataFrames to DataFrames."""

from loomwork.operators.partitioning import (
    bucket_of,
    cuts,
    hash_repartition,
    ordered_ranges,
    per_partition_filter,
    range_filter,
    runtime_stats,
    unordered_ranges,
)
from loomwork.operators.recursion import fixpoint
from loomwork.operators.relational import distinct_on, group_percentiles, interleave, join, mark_join, not_in, unnest
from loomwork.operators.windows import count_distinct_window, groups_frame, parallel_range_window, range_frame, top_n_per_group, user_window

__all__ = [
    "bucket_of", "count_distinct_window", "cuts", "distinct_on", "fixpoint", "group_percentiles", "groups_frame", "hash_repartition", "interleave", "join", "mark_join", "not_in", "ordered_ranges",
    "parallel_range_window", "per_partition_filter", "range_filter", "range_frame", "runtime_stats", "top_n_per_group", "unnest", "unordered_ranges", "user_window",
]
