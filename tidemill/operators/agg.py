"""Aggregates of whole series, of key groups, and of fixed-length stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import Series
from ..functions.scalar import div

#: Aggregates of one column. var and dev are those of the whole population; of no element all but the counts are null.
ONE = {
    "count": F.count, "max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg, "prd": lambda c: F.product(c), "var": F.var_pop, "dev": F.stddev_pop,
    "all": F.bit_and, "any": F.bit_or, "median": lambda c: F.median(c), "approxdc": lambda c: F.approx_count_distinct(c, 0.09),
}
#: Aggregates of two columns; the weights come first. The correlation with a constant is not-a-number.
TWO = {
    "wsum": lambda x, y: F.sum(x.cast("double") * y), "wavg": lambda x, y: F.try_divide(F.sum(x.cast("double") * y), F.sum(x.cast("double"))),
    "cov": F.covar_pop, "corr": lambda x, y: div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)),
}


def one(kind: str, c: Column | str) -> Column:
    return ONE[kind](F.col(c) if isinstance(c, str) else c)


def two(kind: str, x: Column | str, y: Column | str) -> Column:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return TWO[kind](as_col(x), as_col(y))


def grand(df: DataFrame, ids: list[str], **results: Column) -> DataFrame:
    """One row per id. Aggregates of order-free kinds need no positions and combine before the shuffle."""
    return df.groupBy(*ids).agg(*[c.alias(n) for n, c in results.items()])


def by_key(df: DataFrame, keys: list[str], **results: Column) -> DataFrame:
    """One row per key, wherever its rows lie. The average of whole numbers is not cut to a whole number."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in results.items()])


def dup_count(df: DataFrame, keys: list[str], value: str, min_occurrences: int = 1, name: str = "n") -> DataFrame:
    """Per key the number of different values seen at least ``min_occurrences`` times; keys with none have 0."""
    if min_occurrences <= 0:
        raise ValueError("min_occurrences must be positive")
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    return counts.groupBy(*keys).agg(F.count_if(F.col("_n") >= min_occurrences).alias(name))


def grid(s: Series, step: int, **results: Column) -> DataFrame:
    """One row per id and stretch of ``step`` positions; the last stretch may be shorter."""
    cell = F.call_function("div", F.col(s.pos), F.lit(step).cast("long")).alias("cell")
    return s.df.groupBy(*s.ids, cell).agg(*[c.alias(n) for n, c in results.items()])
