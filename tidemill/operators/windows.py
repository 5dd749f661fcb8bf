"""Moving windows and running aggregates.

A window of n starts as n zeros: before n elements have passed, the average and
the variance divide by n, and 0 takes part in the minimum and maximum. For
complete windows only, drop the first n - 1 positions (``reshape.cut_head``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Series
from .recursive import moving_average, smoothed_range


def window(s: Series, kind: str, value: str, n: int) -> Column:
    frame, v = s.trailing(n), F.col(value)
    young = F.col(s.pos) < n - 1
    if kind == "sum":
        return F.sum(v).over(frame)
    if kind == "avg":
        return F.sum(v).over(frame).cast("double") / n
    if kind in ("var", "dev"):
        # around the mean of the present elements, so that nothing cancels out
        m, mean = F.count(v).over(frame), F.avg(v).over(frame)
        spread = F.var_pop(v).over(frame) * m / n + mean * mean * (m * (n - m)) / (n * n)
        return spread if kind == "var" else F.sqrt(spread)
    if kind == "min":
        x = F.min(v).over(frame)
        return F.when(young, F.least(x, F.lit(0).cast("int"))).otherwise(x)
    if kind == "max":
        x = F.max(v).over(frame)
        return F.when(young, F.greatest(x, F.lit(0).cast("int"))).otherwise(x)
    raise ValueError(kind)


def window_ema(s: Series, value: str, n: int, out: str = "ema") -> Series:
    return Series(moving_average(s.df, list(s.ids), s.pos, value, n, out), s.ids, s.pos)


def window_atr(s: Series, value: str, n: int, out: str = "atr") -> Series:
    return Series(smoothed_range(s.df, list(s.ids), s.pos, value, n, out), s.ids, s.pos)


def true_range(s: Series, high: str, low: str, close: str) -> Column:
    """The largest of high - low and the distances of high and low from the close before; high - low for the first element."""
    before = F.lag(close).over(s.w)
    gap = F.greatest(F.abs(F.col(high) - before), F.abs(F.col(low) - before))
    return F.greatest(F.col(high) - F.col(low), F.coalesce(gap, F.lit(0.0)))


def cumulative(s: Series, kind: str, value: str) -> Column:
    v = F.col(value)
    f = {"max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg, "prd": F.product, "var": F.var_pop, "dev": F.stddev_pop, "count": F.count}[kind]
    return f(v).over(s.upto)


def strength(s: Series, value: str, n: int, out: str = "rsi") -> Series:
    """Relative strength index: 100 - 100 / (1 + average gain / average loss), both exponential averages."""
    from ..functions.scalar import div

    change = F.coalesce(F.col(value) - F.lag(value).over(s.w), F.lit(0.0))
    moved = s.with_column("_d", change)
    both = moved.with_column("_g", F.greatest("_d", F.lit(0.0))).with_column("_l", F.greatest(-F.col("_d"), F.lit(0.0)))
    up = window_ema(both, "_g", n, "_ug")
    down = window_ema(up, "_l", n, "_ul")
    index = down.with_column(out, 100 - div(F.lit(100.0), 1 + div(F.col("_ug"), F.col("_ul"))))
    return Series(index.df.drop("_d", "_g", "_l", "_ug", "_ul"), s.ids, s.pos)
