"""Matches by longest prefix and by first suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_prefix(rows: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    """`rows` with the longest of prefixes (prefix) that `column` begins with, or null.

    Each row meets its own prefixes by an equi-join on those lengths that occur, not all prefixes by comparison.
    """
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect() if r[0] is not None]  # a number per length
    starts = F.array(*[F.when(F.length(column) >= n, F.substring(column, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    own = rows.select(column).distinct().select(column, F.explode(starts).alias("prefix")).where("prefix is not null")
    best = own.join(prefixes.select("prefix").distinct(), "prefix").groupBy(column).agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix")).alias("best"))
    return rows.join(best.select(column, F.col("best.prefix").alias("prefix")), column, "left")


def suffixes(column: str) -> Column:
    """The whole of a key, and what follows each of its underscores."""
    parts = F.split(column, "_")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))


def first_suffix(keys: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """`keys` matched with names (name, rank): equal, or ending in _name; the least rank counts, then the name.

    A key's suffixes after each underscore are looked up by an equi-join.
    """
    own = keys.select(column).distinct().select(column, F.explode(suffixes(column)).alias("name"))
    order = Window.partitionBy(column).orderBy("rank", "name")
    best = own.join(names, "name").withColumn("rn", F.row_number().over(order)).where("rn = 1").select(column, "name")
    return keys.join(best, column, "left")
