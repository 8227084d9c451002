"""Recursive queries with UNION: distinct rows until a step brings none that are new."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame

from loomwork.scratch import shared_folder


def _checkpoint(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 10_000) -> DataFrame:
    """seed and all rows that steps from new rows reach; only new rows go into the next step.

    What each step finds is written once and stays apart; parts of the same size class are written together,
    so a row is written O(log n) times and a step reads O(log n) parts.
    """
    frontier = _checkpoint(seed.distinct())
    parts = [(frontier.count().bit_length(), frontier)]
    for _ in range(most):
        found = functools.reduce(DataFrame.union, (df for _, df in parts))
        frontier = _checkpoint(step(frontier).toDF(*seed.columns).subtract(found))
        n = frontier.count()
        if not n:
            return found
        new = frontier
        while parts and parts[-1][0] <= n.bit_length():
            new = _checkpoint(parts.pop()[1].union(new))
            n = new.count()
        parts.append((n.bit_length(), new))
    raise RuntimeError(f"no end after {most} steps")
