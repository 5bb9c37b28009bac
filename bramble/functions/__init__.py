"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def average_degree_ceiling(edges: Column, vertices: Column) -> Column:
    """ceil(2 m / n) in whole numbers; 0 for an edgeless graph."""
    return F.when(vertices > 0, F.floor((2 * edges + vertices - 1) / vertices)).cast("bigint")


def ratio(value: Column, by: Column, zero_policy: str = "inf") -> Column:
    """value / by as double; where by is 0: infinity ('inf') or 0 ('zero'). NULL stays NULL."""
    if zero_policy not in ("inf", "zero"):
        raise ValueError("zero_policy is 'inf' or 'zero'")
    other = float("inf") if zero_policy == "inf" else 0.0
    return F.when(value.isNull() | by.isNull(), F.lit(None).cast("double")).when(by > 0, value.cast("double") / by).otherwise(F.lit(other))


def mark(ok: Column) -> Column:
    """A check mark or a cross."""
    return F.when(ok, "✓").when(~ok, "✗")
