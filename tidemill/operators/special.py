"""Histograms, crossings of zero and extrema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Series
from .reshape import with_trend


def histogram(df: DataFrame, ids: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(ids, bin, n): counts in equal bins of [low, high); others are left out, empty bins have 0."""
    v = F.col(value).cast("double")
    inside = (v >= low) & (v < high)
    cell = F.least(F.floor((v - low) * bins / (high - low)).cast("int"), F.lit(bins - 1))
    counts = df.groupBy(*ids, F.when(inside, cell).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("_m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("_m", b), F.lit(0)))
    return found.select(*ids, F.posexplode(every).alias("bin", "n"))


def cross(s: Series, value: str, direction: int = 0) -> DataFrame:
    """Positions where the sign changes; with zeros between, that of the first zero. direction 1 or -1 keeps changes to that sign."""
    sign = F.signum(F.col(value)).cast("int")
    signed = s.with_column("_s", sign)
    at = F.when(F.col("_s") != 0, F.struct(F.col("_s").alias("s"), F.col(s.pos).alias("p")))
    before = signed.with_column("_b", F.last(at, ignorenulls=True).over(s.w.rowsBetween(Window.unboundedPreceding, -1)))
    hit = (F.col("_s") != 0) & F.col("_b").isNotNull() & (F.col("_b.s") != F.col("_s"))
    if direction:
        hit = hit & (F.col("_s") == direction)
    return before.df.where(hit).select(*s.ids, (F.col("_b.p") + 1).alias(s.pos))


def extrema(s: Series, value: str, kind: int = 0) -> DataFrame:
    """Positions of the last element before the trend turns: maxima (kind 1), minima (-1) or both (0)."""
    t = with_trend(s, value, "_t").with_column("_p", F.lag("_t").over(s.w))
    hit = F.col("_t") * F.col("_p") == -1
    if kind:
        hit = hit & (F.col("_p") == kind)
    return t.df.where(hit).select(*s.ids, (F.col(s.pos) - 1).alias(s.pos))
