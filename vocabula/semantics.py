"""Conventions that all operators share, so that Spark, SQL and the rules' definitions agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space in the wide sense: also no-break and ideographic spaces.
SPACE = r"\t\n\x0B\f\r    -     　﻿"


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d on the binary double, not decimal rounding."""
    k = float(10**digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k)


def wide_trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Fixed dictionary as an expression; null (or the default) for other keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the last in `order`. Spark limits each group before the shuffle, so copies of a hot key do not meet in one task,
    and columns that are not used later are not read."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def numbered(df: DataFrame, partition: list[str], order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
