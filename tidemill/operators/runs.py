"""Aggregates of runs: neighbours with equal keys. A key that comes back starts a new run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Series
from .agg import ONE


def with_runs(s: Series, keys: list[str], name: str = "run_id") -> Series:
    """Numbers of the runs, from 0. A null is equal to a null."""
    key = F.struct(*keys)
    new = F.when(F.lag(key).over(s.w).isNull(), F.lit(1)).otherwise((~key.eqNullSafe(F.lag(key).over(s.w))).cast("int"))
    return s.with_column("_new", new).with_column(name, (F.sum("_new").over(s.upto) - 1).cast("long"))


def _measure(kind: str, value: str, pos: str) -> Column:
    if kind == "first":
        return F.min_by(value, pos)
    if kind == "last":
        return F.max_by(value, pos)
    if kind == "distinct":
        return F.count_distinct(value)
    return ONE[kind](F.col(value))


def by_run(s: Series, keys: list[str], **results: tuple[str, str]) -> DataFrame:
    """One row per run: ids, run_id and each (kind, value)."""
    r = with_runs(s, keys)
    return r.df.groupBy(*s.ids, "run_id").agg(*[_measure(kind, value, s.pos).alias(n) for n, (kind, value) in results.items()])


def over_run(s: Series, keys: list[str], **results: tuple[str, str]) -> Series:
    """Every element with the aggregates of its run."""
    r = with_runs(s, keys)
    run = Window.partitionBy(*s.ids, "run_id")
    df = r.df
    for n, (kind, value) in results.items():
        df = df.withColumn(n, _measure(kind, value, s.pos).over(run))
    return Series(df.drop("_new"), s.ids, s.pos)
