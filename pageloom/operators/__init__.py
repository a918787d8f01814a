"""Relational operators over captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps take as computed values.

    The optimizer substitutes a column's definition into every filter and projection above it. For long
    expressions used many times (URL resolution on top of URL normalisation) that multiplies both the plan and
    the work. Passing the values through a one-element ``inline`` keeps each computed exactly once per row.
    """
    kept = [c for c in df.columns if c not in columns]
    held = df.select(*kept, *[c.alias(f"_{n}") for n, c in columns.items()])
    return held.select(*kept, F.inline(F.array(F.struct(*[F.col(f"_{n}").alias(n) for n in columns]))))
