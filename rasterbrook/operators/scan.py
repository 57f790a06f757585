"""Running sums and neighbours along an order, for groups of any length.

The order is a whole number. Rows are dealt by group and stretch of it, so no
task holds a group: sums within stretches, the running sum of the stretches'
totals, and both added. What meets in one task is a stretch, or a row for each
stretch of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order that make a stretch.
STRETCH = 1 << 12


def _stretched(df: DataFrame, order: str, stretch: int) -> DataFrame:
    return df.withColumn("_stretch", F.floor(F.col(order) / stretch))


def running_sum(df: DataFrame, by: list[str], order: str, sums: dict[str, str | Column], inclusive: bool = True, stretch: int = STRETCH) -> DataFrame:
    """df with a column for each of sums: the sum of its value over all rows of the group up to this one, or up to the one before. Rows of equal order are all before each other's next; nulls add nothing."""
    keys = [*by, "_stretch"]
    source = _stretched(df, order, stretch).withColumns({f"_{c}": F.col(v) if isinstance(v, str) else v for c, v in sums.items()})
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = source.groupBy(*keys).agg(*(F.sum(f"_{c}").alias(f"_{c}_t") for c in sums))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, *(zero(F.sum(f"_{c}_t").over(before)).alias(f"_{c}_b") for c in sums))
    own = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = source.withColumns({f"_{c}_l": zero(F.sum(f"_{c}").over(own)) for c in sums})
    joined = null_safe(local, bases, keys)
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c not in sums), *((F.col(f"_{c}_l") + F.col(f"_{c}_b")).alias(c) for c in sums))


def previous(df: DataFrame, by: list[str], order: str, value: str, name: str = "previous", stretch: int = STRETCH) -> DataFrame:
    """df with the value of the row before in the group, null for the first: within a stretch from the row itself, at its start from the last row of the stretch before."""
    keys = [*by, "_stretch"]
    source = _stretched(df, order, stretch)
    last = source.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_last"))
    edges = last.select(*keys, F.lag("_last").over(Window.partitionBy(*by).orderBy("_stretch")).alias("_edge"))
    own = Window.partitionBy(*keys).orderBy(order)
    local = source.withColumn("_before", F.lag(F.struct(F.col(value).alias("v"))).over(own))
    joined = null_safe(local, edges, keys)
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.coalesce("_before", "_edge")["v"].alias(name))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's other columns; right has a row for each key of left, which may be null."""
    renamed = right.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & left[f"`{c}`"].eqNullSafe(F.col(f"_k{i}"))
    return left.join(renamed, on).drop(*(f"_k{i}" for i in range(len(keys))))
