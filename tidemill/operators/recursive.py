"""Moving averages that depend on their own last value, as a linear scan of sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans import single


def _groups(pdf: pd.DataFrame, ids: list[str]) -> np.ndarray:
    """Number of the run of equal ids that each row belongs to."""
    if not ids:
        return np.zeros(len(pdf), np.int64)
    new = np.zeros(len(pdf), bool)
    for c in ids:
        x = pdf[c].to_numpy(object)
        new[1:] |= ~((x[1:] == x[:-1]) | (pd.isna(x[1:]) & pd.isna(x[:-1])))
    return np.cumsum(new)


def _ewm(values: np.ndarray, group: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(values).groupby(group, sort=False).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()


def _average(batches: Iterator[pd.DataFrame], ids: list[str], value: str, alpha: float, out: str, seed: float | None) -> Iterator[pd.DataFrame]:
    last: pd.DataFrame | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        x, group = pdf[value].to_numpy(float), _groups(pdf, ids)
        goes_on = last is not None and bool(_groups(pd.concat([last[ids], pdf[ids].head(1)]), ids)[-1] == 0) if ids else last is not None
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        # what the average holds before each run: the carried state, the seed, or nothing
        state = np.full(len(starts), np.nan if seed is None else seed)
        if goes_on:
            state[0] = last[out].iloc[0]
        held = ~np.isnan(state)
        at = starts[held]
        both, both_group = np.insert(x, at, state[held]), np.insert(group, at, group[at])
        y = _ewm(both, both_group, alpha)
        y = np.delete(y, at + np.arange(len(at)))
        res = pdf.assign(**{out: y})
        last = res.tail(1)
        yield res


def _wilder(batches: Iterator[pd.DataFrame], ids: list[str], pos: str, value: str, n: int, out: str) -> Iterator[pd.DataFrame]:
    last: pd.DataFrame | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        x, p, group = pdf[value].to_numpy(float), pdf[pos].to_numpy(np.int64), _groups(pdf, ids)
        goes_on = last is not None and bool(_groups(pd.concat([last[ids], pdf[ids].head(1)]), ids)[-1] == 0) if ids else last is not None
        acc = float(last[out].iloc[0]) if goes_on else 0.0
        y = np.empty(len(x))
        # the first n values of a series: running mean
        young = p < n
        sums = np.where(young, x, 0.0)
        if goes_on and young[0]:
            sums[0] += acc * p[0]
        total = pd.Series(sums).groupby(group, sort=False).cumsum().to_numpy()
        y[young] = total[young] / (p[young] + 1)
        old = np.flatnonzero(~young)
        if len(old):
            # afterwards acc + (v - acc) / n, from the mean of the first n
            feed, feed_group = x.copy(), group
            seeds = np.flatnonzero(young & (p == n - 1))
            feed[seeds] = y[seeds]
            keep = ~young
            keep[seeds] = True
            values, groups = feed[keep], feed_group[keep]
            lead = goes_on and not young[0]
            if lead:
                values, groups = np.insert(values, 0, acc), np.insert(groups, 0, group[0])
            smooth = _ewm(values, groups, 1.0 / n)[1 if lead else 0 :]
            full = np.empty(len(x))
            full[keep] = smooth
            y[old] = full[old]
        res = pdf.assign(**{out: y})
        last = res.tail(1)
        yield res


def scan_sorted(df: DataFrame, ids: list[str], value: str, alpha: float, out: str, seed: float | None = None) -> DataFrame:
    """scan_average of partitions that are sorted already; each begins anew."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    return df.mapInPandas(lambda it: _average(it, ids, value, alpha, out, seed), schema)


def _sorted(df: DataFrame, ids: list[str], pos: str) -> DataFrame:
    return df.repartition(*ids).sortWithinPartitions(*ids, pos)


def scan_average(df: DataFrame, ids: list[str], pos: str, value: str, alpha: float, out: str, seed: float | None = None) -> DataFrame:
    """df with the exponential average of value by ids in order of pos. Without a seed the first value is the first average. Nulls keep the average."""
    return scan_sorted(_sorted(df, ids, pos), ids, value, alpha, out, seed)


def moving_average(df: DataFrame, ids: list[str], pos: str, value: str, n: int, out: str) -> DataFrame:
    """Exponential average of weight 2 / (n + 1). A series with an id is scanned by one task, one without ids in chunks."""
    if not ids:
        return single.moving_average(df, [pos], value, n, out)
    return scan_average(df, ids, pos, value, 2.0 / (n + 1), out)


def smoothed_range(df: DataFrame, ids: list[str], pos: str, value: str, n: int, out: str) -> DataFrame:
    """Running mean over the first n values, then acc * (n - 1) / n + v / n. pos counts from 0; value has no nulls. A series without ids is scanned in chunks."""
    if not ids:
        return single.smoothed_range(df, [pos], value, n, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    return _sorted(df, ids, pos).mapInPandas(lambda it: _wilder(it, ids, pos, value, n, out), schema)
