"""Sorting, ranks, best elements and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Series


def _order(s: Series, value: str, descending: bool) -> list[Column]:
    return [F.col(value).desc() if descending else F.col(value).asc(), F.col(s.pos)]


def sort(s: Series, value: str, descending: bool = False) -> Series:
    """Elements in order of value; equal ones keep theirs. The old position stays as ``from_pos``."""
    w = Window.partitionBy(*s.ids).orderBy(*_order(s, value, descending))
    return Series(s.df.withColumn("_k", (F.row_number().over(w) - 1).cast("long")).withColumnRenamed(s.pos, "from_pos").withColumnRenamed("_k", s.pos), s.ids, s.pos)


def rank(s: Series, value: str, descending: bool = False, dense: bool = False) -> Column:
    """1-based rank; equal values share the lowest."""
    w = Window.partitionBy(*s.ids).orderBy(_order(s, value, descending)[0])
    return (F.dense_rank() if dense else F.rank()).over(w)


def top(s: Series, value: str, k: int, smallest: bool = False) -> DataFrame:
    """The k best elements of each id with their positions; of equal ones the earlier comes first. Spark keeps only k rows of an id per task before the shuffle."""
    w = Window.partitionBy(*s.ids).orderBy(*_order(s, value, not smallest))
    return s.df.select(*s.ids, s.pos, value).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def quantiles(s: Series, value: str, q: int) -> DataFrame:
    """q + 1 order statistics: elements count * i div q of the sorted series for i < q, and the greatest."""
    w = Window.partitionBy(*s.ids).orderBy(F.col(value))
    numbered = s.df.select(*s.ids, F.col(value).alias("v"), (F.row_number().over(w) - 1).alias("_k"), F.count(F.lit(1)).over(s.whole).alias("_n"))
    # the element of rank k answers the parts i with k <= n * i / q < k + 1, the last one also q; most elements answer none
    k, n = F.col("_k"), F.col("_n")
    up = lambda x: F.call_function("div", x * q + n - 1, n)
    answered = numbered.withColumn("_a", up(k)).withColumn("_b", F.least(up(k + 1), F.lit(q).cast("long")) - 1).where("_a <= _b or _k = _n - 1")
    none = F.array().cast("array<int>")
    parts = F.concat(F.when(F.col("_a") <= F.col("_b"), F.sequence(F.col("_a").cast("int"), F.col("_b").cast("int"))).otherwise(none), F.when(k == n - 1, F.array(F.lit(q))).otherwise(none))
    return answered.select(*s.ids, F.explode(parts).alias("part"), "v")
