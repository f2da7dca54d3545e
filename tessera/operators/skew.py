"""Joins with a table that was just aggregated by the join keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_reduced(rows: DataFrame, reduced: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows.join(reduced, keys, how)`` in a form whose hot keys adaptive execution can split.

    The output of an aggregate is already partitioned by its keys.  Joined
    directly, its side needs no exchange, and a join with an exchange on one side
    only is never split: all rows of a hot key stay in one task.  A hash of the
    keys as one more join key makes both sides exchange; ``reduced`` has a row per
    key, so that costs little.  The hash is only computed, never shuffled.
    """
    right = reduced.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in reduced.columns])
    own = [f"_r_{k}" for k in keys]
    same = F.xxhash64(*keys) == F.xxhash64(*own)
    for k, r in zip(keys, own):
        same = same & (F.col(k) == F.col(r))
    return rows.join(right, same, how).drop(*own)
