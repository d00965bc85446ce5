"""Small relational helpers that the other operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; a null key is a key of its own.

    An aggregate, not a window: rows are combined before they are shuffled, so a key that holds a
    third of all rows makes no large task. Ties are broken by all columns, in their order.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row"))
    got = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(packed).alias("__x"))
    return got.select(*[F.col(f"`{k}`") if k in keys else F.col(f"__x.__row.`{k}`").alias(k) for k in df.columns])


def descending(c: Column) -> Column:
    """A number or time in falling order, for ``first_of``; nulls last."""
    return -F.coalesce(c.cast("double"), F.lit(float("-inf")))


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with a running number from 1 within each key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return numbered(df, keys, order, "__n").where(F.col("__n") <= n).drop("__n")
