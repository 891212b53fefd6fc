"""Interval joins and dimension lookups; the same functions serve stored and streaming tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, on: Column, left_ts: str, right_ts: str, low: str, high: str, how: str = "inner") -> DataFrame:
    """Rows that meet ``on`` with right_ts within [left_ts + low, left_ts + high], bounds included.

    On streams both sides need a watermark; the interval bounds the state.
    """
    a, b = f"interval {low}", f"interval {high}"
    return left.join(right, on & F.expr(f"{right_ts} >= {left_ts} + {a} and {right_ts} <= {left_ts} + {b}"), how)


def enrich(facts: DataFrame, dimension: DataFrame, key: str, columns: dict[str, str], dim_key: str = "id", how: str = "inner") -> DataFrame:
    """facts with columns of the dimension's row for their key: {new name: dimension's column}.

    A new name replaces a column of that name. With ``how="inner"`` a fact
    without its dimension is dropped, with ``"left"`` it has nulls. Whether the
    dimension is broadcast is left to its size.
    """
    own = dimension.select(F.col(dim_key).alias("_dim_key"), *[F.col(c).alias(f"_dim_{n}") for n, c in columns.items()])
    alike = dict(facts.dtypes).get(key) == dict(own.dtypes)["_dim_key"]
    on = F.col(key) == F.col("_dim_key") if alike else F.col(key).cast("string") == F.col("_dim_key").cast("string")
    out = facts.join(own, on, how)
    return out.withColumns({n: F.col(f"_dim_{n}") for n in columns}).drop("_dim_key", *[f"_dim_{n}" for n in columns])
