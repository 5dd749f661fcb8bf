"""One row per source and time out of rows that were loaded more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """Of the rows with equal keys the one with the greatest version.

    A null version is older than any. Among rows of equal version the one with
    the greatest values counts, in the order given (null least, not-a-number
    greatest), so the result doesn't depend on the order of the rows. Rows with a
    null key are left out. Copies are combined before the shuffle, so a key with
    a third of all rows is one row per task.
    """
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    best = present.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("_version"), *values)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def first_and_latest_rows(df: DataFrame, keys: list[str], version: str, values: list[str], on_time: Column) -> DataFrame:
    """Like latest_rows, with the values as structs: ``first`` of the rows that were on time, null where there is none, and ``latest`` of all."""
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    row = F.struct(F.col(version).alias("_version"), *values)
    return present.groupBy(*keys).agg(F.max(F.when(on_time, row)).alias("first"), F.max(row).alias("latest"))


def quote_loads(quotes: DataFrame, values: list[str], days: int) -> DataFrame:
    """symbol, day, first, latest: every reading as it was ``days`` days after its day (rows without a time of loading among it) and as it is."""
    rows = quotes.select(F.upper(F.trim("symbol")).alias("symbol"), "day", "loaded_at", *values)
    on_time = F.coalesce(F.datediff(F.to_date("loaded_at"), "day") <= days, F.lit(True))
    return first_and_latest_rows(rows, ["symbol", "day"], "loaded_at", values, on_time)


def quote_readings(quotes: DataFrame, values: list[str]) -> DataFrame:
    """Readings of the quotes table: symbols without blanks around them and in upper case, one row a symbol and day."""
    rows = quotes.select(F.upper(F.trim("symbol")).alias("symbol"), "day", "loaded_at", *values)
    return latest_rows(rows, ["symbol", "day"], "loaded_at", values)
