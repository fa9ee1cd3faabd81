"""Merging results of several passes and recordings, and filling a dense grid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row for each key, from the first part that has it, and in that the first by `order`. The aggregation keeps one row
    for each key and task, so that a key that repeats costs no sort."""
    tagged = [p.withColumn("part_", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in every.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("part_", *order))
    return every.groupBy(*keys).agg(best.alias("b_")).select(*keys, *[F.col(f"b_.`{c}`").alias(c) for c in rest if c != "part_"])


def first_valid_per_key(df: DataFrame, keys: Sequence[str], ok: Column, order: Sequence[str]) -> DataFrame:
    rows = df.where(ok)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("b_")).select(*keys, *[F.col(f"b_.`{c}`").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], ok: str) -> DataFrame:
    """Rows of `old` that are valid or without a new row, new rows in place of those that are not, and all other new rows.
    One row for each key on either side."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("old_"))
    b = new.select(*keys, F.struct(*rest).alias("new_"))
    both = a.join(b, list(keys), "full")
    take = F.when(F.col("old_").isNull(), F.col("new_")).when(F.col("new_").isNull() | F.coalesce(F.col(f"old_.`{ok}`"), F.lit(False)), F.col("old_")).otherwise(F.col("new_"))
    return both.withColumn("b_", take).select(*keys, *[F.col(f"b_.`{c}`").alias(c) for c in rest])


#: Values of an axis up to which it is broadcast.
AXIS = 100_000


def _grid(axes: Sequence[DataFrame]) -> DataFrame:
    """Every combination of the axes, which is the result's size; an axis is broadcast once it has been counted."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b) if b.limit(AXIS + 1).count() <= AXIS else b), axes)


def dense_grid(axes: Sequence[DataFrame], values: DataFrame, keys: Sequence[str], fill: dict) -> DataFrame:
    """Every combination of the axes (lists of key values each) with its row of `values`, or `fill` where it has none."""
    full = _grid(axes).join(values, list(keys), "left")
    return full.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def missing(axes: Sequence[DataFrame], values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combinations of the axes that `values` lacks."""
    return _grid(axes).join(values.select(*keys).distinct(), list(keys), "left_anti")


def best_of(df: DataFrame, keys: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """The row of each key that comes first by `rank`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("b_")).select(*keys, *[F.col(f"b_.`{c}`").alias(c) for c in rest])
