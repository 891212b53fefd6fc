"""Column names: lower_underscore to lowerCamel, and case-insensitive lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame


def camel(name: str) -> str:
    head, *rest = name.lower().split("_")
    return head + "".join(part.capitalize() for part in rest)


def camel_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*map(camel, df.columns))


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])
