"""Implausible readings: physical limits, spikes and stuck values, each source against its own behaviour."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeaxis import axis
from ..plans.cut import table_cut
from ..plans.single import positions

#: Reasons as bits of one number.
LIMITS, SPIKE, STUCK = 1, 2, 4


def typical_change(y: np.ndarray) -> float:
    """Median size of the changes that aren't zero; 0 for a series without changes."""
    d = np.abs(np.diff(y))
    d = d[d > 0]
    return float(np.median(d)) if len(d) else 0.0


def autoregression(y: np.ndarray, most: float) -> tuple[float, float, np.ndarray]:
    """(coefficient, scale, clipped changes) of a robust first-order autoregression of the changes of y.

    The scale is the typical change, at most ``most``. Changes enter the fit and
    the forecasts clipped at three scales, so an outlier neither bends the
    coefficient nor spoils the forecasts beside it.
    """
    scale = min(typical_change(y), most)
    d = np.clip(np.diff(y), -3 * scale, 3 * scale)
    weight = float(d[:-1] @ d[:-1])
    return (float(np.clip((d[1:] @ d[:-1]) / weight, -0.9, 0.9)) if weight > 0 else 0.0), scale, d


def additive_outliers(y: np.ndarray, factor: float, longest: int, typical: float | None = None) -> np.ndarray:
    """Positions of y in runs of at most ``longest`` that depart and return.

    The autoregression forecasts a run's first value from those before it and,
    backwards, its last one from those after it. A run beyond both forecasts, on
    one side, is an additive outlier; one beyond the first alone is a shift of the
    level, which stays and is no case. Both tests are made at factor less three
    coefficients of the scale, as much as a clean neighbour may explain. Exact
    check of what they find: all of the run lies beyond both neighbours by more
    than factor times ``typical`` (the typical change of y unless given).

    The clearest outliers are removed, the autoregression is estimated again and
    the tests repeated on what is left, until nothing is found; removed readings
    still count towards a run's length.
    """
    out = np.zeros(len(y), bool)
    typical = typical_change(y) if typical is None else typical
    if typical == 0.0 or len(y) < 3:
        return out
    kept = np.arange(len(y))
    while len(kept) >= 3:
        z = y[kept]
        n = len(z)
        phi, scale, d = autoregression(z, typical)
        bound = (factor - 3 * abs(phi)) * scale
        # what the autoregression expects at each reading, from the two before it and from the two after it
        ahead, back = np.full(n, np.nan), np.full(n, np.nan)
        ahead[1:] = z[:-1] + phi * np.append(0.0, d[:-1])
        back[:-1] = z[1:] - phi * np.append(d[1:], 0.0)
        jump = np.flatnonzero(np.abs(z[1:] - ahead[1:]) > bound) + 1
        best: list[tuple[float, int, int]] = []
        for length in range(1, min(longest, n - 2) + 1):
            at = jump[jump < n - length]
            if not len(at):
                continue
            run = z[at[:, None] + np.arange(length)[None, :]]
            side = np.where(z[at] > ahead[at], 1.0, -1.0)
            low = np.where(side > 0, run.min(axis=1), run.max(axis=1))
            level_shift = side * (low - back[at + length - 1]) <= bound  # the run agrees with what follows
            outlier = (side * (low - ahead[at]) > bound) & ~level_shift
            depth = np.minimum(side * (low - z[at - 1]), side * (low - z[at + length]))
            fits = outlier & (depth > factor * typical) & (kept[at + length - 1] - kept[at] < longest)
            best += [(float(v), int(i), length) for v, i in zip(depth[fits], at[fits])]
        if not best:
            break
        taken = np.zeros(n, bool)
        for _, i, length in sorted(best, key=lambda x: (-x[0], x[2], x[1])):
            if not taken[max(i - 1, 0) : i + length + 1].any():
                taken[i : i + length] = True
        out[kept[taken]] = True
        kept = kept[~taken]
    return out


def long_runs(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in runs of at least ``least`` equal values, whether a value repeats the one before)."""
    again = np.zeros(len(x), bool)
    again[1:] = x[1:] == x[:-1]
    starts = np.flatnonzero(~again)
    sizes = np.diff(np.append(starts, len(x)))
    return np.repeat(sizes >= least, sizes), again


def stuck_runs(x: np.ndarray, least: int, most_repeats: float) -> np.ndarray:
    """Positions in runs of at least ``least`` equal values, if outside such runs a value repeats its predecessor in at most ``most_repeats`` of all pairs."""
    inside, again = long_runs(x, least)
    pairs, repeats = max(len(x) - 1, 0) - (inside & again).sum(), (again & ~inside).sum()
    return np.zeros(len(x), bool) if pairs and repeats / pairs > most_repeats else inside


def _in_order(t: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Order by time; rows of equal time by their values."""
    order = np.argsort(t, kind="stable")
    return np.lexsort((*reversed(values), t)) if (np.diff(t[order]) == 0).any() else order


def _flags(table: pa.Table, fields: list[str], stuck: dict[str, bool], factor: float, longest: int, least: int, most_repeats: float) -> pa.Table:
    """One source's readings -> those with a reason."""
    t = table["t"].to_numpy()
    values = {c: np.asarray(table[c].to_numpy(), float) for c in dict.fromkeys([*fields, *stuck])}
    order = _in_order(t, list(values.values()))
    reason = np.where(table["impossible"].to_numpy()[order], LIMITS, 0)
    values = {c: x[order] for c, x in values.items()}
    for name in fields:
        x = values[name]
        at = np.flatnonzero(np.isfinite(x) & (x > 0))
        reason[at[additive_outliers(np.log(x[at]), factor, longest)]] |= SPIKE
    for name, zero_too in stuck.items():
        x = values[name]
        at = np.flatnonzero(~np.isnan(x))
        found = stuck_runs(x[at], least, most_repeats)
        if not zero_too:
            found &= x[at] != 0
        reason[at[found]] |= STUCK
    hit = np.flatnonzero(reason > 0)
    return pa.table({"source": table["source"].take(pa.array(order[hit])), "t": pa.array(t[order[hit]], pa.int64()), "reason": pa.array(reason[hit], pa.int64())})


def _piece_flags(table: pa.Table, tested: int, factor: float, longest: int, least: int) -> pa.Table:
    """A piece of one source's values of one field, with the readings on either side -> its own ones with a reason, and one row of counts."""
    t, x, own = table["t"].to_numpy(), table["v"].to_numpy(), table["own"].to_numpy()
    order = np.argsort(table["pos"].to_numpy())
    t, x, own = t[order], x[order], own[order]
    if tested == SPIKE:
        found, pairs, repeats = additive_outliers(x, factor, longest, float(table["typical"][0].as_py() or 0.0)), 0, 0
    else:
        found, again = long_runs(x, least)
        begins = table["pos"].to_numpy()[order] == 0
        pairs, repeats = int((own & ~begins & ~(found & again)).sum()), int((own & again & ~found).sum())
    hit = np.flatnonzero(found & own)
    n = len(hit)
    zero = np.zeros(n, np.int64)
    return pa.table(
        {
            "source": table["source"].combine_chunks().take(pa.array(np.zeros(n + 1, np.int64))), "field": pa.array([table["field"][0].as_py()] * (n + 1)),
            "t": pa.array([*t[hit].tolist(), None], pa.int64()), "v": pa.array([*x[hit].tolist(), None], pa.float64()),
            "pairs": pa.array(np.append(zero, pairs), pa.int64()), "repeats": pa.array(np.append(zero, repeats), pa.int64()),
        }
    )


def _long_values(rows: DataFrame, columns: list[str], usable, chunk: int, halo: int) -> DataFrame:
    """(source, field, t, v, pos, part, own): the usable values of every column as series of their own, in pieces of ``chunk`` values together with the ``halo`` values on either side."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in columns])
    values = rows.select("source", "t", F.inline(pairs)).where(usable(F.col("v")))
    placed = positions(values, ["t", "v"], "pos", ["source", "field"])
    at, part = F.col("pos") % chunk, F.call_function("div", F.col("pos"), F.lit(chunk).cast("long"))
    piece = lambda p, own: F.struct(p.alias("part"), F.lit(own).alias("own"))
    beside = F.array_compact(F.array(piece(part, True), F.when((at < halo) & (part > 0), piece(part - 1, False)), F.when(at >= chunk - halo, piece(part + 1, False))))
    return placed.select("*", F.inline(beside))


def _in_pieces(rows: DataFrame, fields: list[str], stuck: dict[str, bool], factor: float, longest: int, least: int, most_repeats: float, chunk: int, halo: int) -> DataFrame:
    """(source, t, reason) of sources of any length."""
    if not least <= halo <= chunk:
        raise ValueError("halo must be from least_stuck to chunk")
    schema = T.StructType([rows.schema["source"], *(T.StructField(c, k) for c, k in (("field", T.StringType()), ("t", T.LongType()), ("v", T.DoubleType()), ("pairs", T.LongType()), ("repeats", T.LongType())))])
    by_field, reasons = ["source", "field"], rows.where("impossible").select("source", "t", F.lit(LIMITS).cast("long").alias("reason"))
    if fields:
        reasons = reasons.unionByName(_spikes_in_pieces(rows, fields, by_field, factor, longest, least, chunk, halo, schema))
    if stuck:
        reasons = reasons.unionByName(_stuck_in_pieces(rows, stuck, by_field, factor, longest, least, most_repeats, chunk, halo, schema))
    return reasons.groupBy("source", "t").agg(F.bit_or("reason").alias("reason"))


def _spikes_in_pieces(rows, fields, by_field, factor, longest, least, chunk, halo, schema) -> DataFrame:
    # against the typical change of the whole source
    positive = table_cut(_long_values(rows, fields, lambda v: (v > 0) & (v < float("inf")), chunk, halo).withColumn("v", F.log("v")), "pieces")
    before = Window.partitionBy(*by_field, "part").orderBy("pos")
    change = F.abs(F.col("v") - F.lag("v").over(before))
    sizes = positive.withColumn("size", change).where("own and size > 0")
    # exact up to a million different changes, and to a millionth of their ranks beyond: the lower and the upper median
    middle = lambda c: F.percentile_approx(c, 0.5, 1_000_000)
    typical = sizes.groupBy(*by_field).agg(((middle(F.col("size")) - middle(-F.col("size"))) / 2).alias("typical"))
    known = positive.join(typical, by_field)
    return known.groupBy(*by_field, "part").applyInArrow(lambda table: _piece_flags(table, SPIKE, factor, longest, least), schema).where("t is not null").select("source", "t", F.lit(SPIKE).cast("long").alias("reason"))


def _stuck_in_pieces(rows, stuck, by_field, factor, longest, least, most_repeats, chunk, halo, schema) -> DataFrame:
    # of sources that otherwise seldom repeat a value
    numbers = _long_values(rows, list(stuck), lambda v: v.isNotNull() & ~F.isnan(v), chunk, halo)
    found = table_cut(numbers.groupBy(*by_field, "part").applyInArrow(lambda table: _piece_flags(table, STUCK, factor, longest, least), schema), "stuck")
    counts = found.groupBy(*by_field).agg(F.sum("pairs").alias("all_pairs"), F.sum("repeats").alias("all_repeats"))
    seldom = counts.where(F.col("all_repeats") <= most_repeats * F.col("all_pairs")).select(*by_field)
    zeros = [c for c, zero_too in stuck.items() if not zero_too]
    runs = found.where(F.col("t").isNotNull() & ~(F.col("field").isin(zeros) & (F.col("v") == 0))).join(seldom, by_field, "left_semi")
    return runs.select("source", "t", F.lit(STUCK).cast("long").alias("reason"))


def implausible(
    readings: DataFrame, source: str, time: str, fields: list[str], limits: Column, stuck: dict[str, bool], factor: float = 8.0, longest: int = 3,
    least_stuck: int = 5, most_repeats: float = 0.05, chunk: int | None = None, halo: int = 64,
) -> DataFrame:
    """(source, t, limits, spike, stuck) of the readings for which one of the three holds.

    ``limits`` is the condition under which a reading is impossible (null counts
    as no). ``fields`` are tested for spikes on the logarithm of their finite
    positive values, others are passed over as if absent. ``stuck`` names the
    fields tested for runs of equal values and whether runs of zero count. There
    is to be one row per source and time (repeated rows are neighbours of each
    other); rows with a null in either are left out. A series of fewer than three
    values has no spikes.

    Each source is one group of the scan. Where a source can be longer than a
    task's memory, ``chunk`` cuts the values of each field into pieces of so many,
    each with the ``halo`` values before and after it, however far away they are.
    What belongs to the whole source (its typical change, how often it repeats a
    value) is found from all pieces, so the rows are the same.
    """
    columns = list(dict.fromkeys([*fields, *stuck]))
    rows = readings.select(F.col(source).alias("source"), axis(readings, time).alias("t"), *columns, F.coalesce(limits, F.lit(False)).alias("impossible"))
    rows = rows.where("source is not null and t is not null")
    numeric = rows.select("source", "t", "impossible", *[F.col(c).cast("double").alias(c) for c in columns])
    if chunk is None:
        schema = T.StructType([T.StructField("source", rows.schema["source"].dataType), T.StructField("t", T.LongType()), T.StructField("reason", T.LongType())])
        found = numeric.groupBy("source").applyInArrow(lambda table: _flags(table, fields, stuck, factor, longest, least_stuck, most_repeats), schema)
    else:
        found = _in_pieces(table_cut(numeric, "readings"), fields, stuck, factor, longest, least_stuck, most_repeats, chunk, halo)
    bit = lambda k: F.col("reason").bitwiseAND(F.lit(k)) != 0
    return found.select(F.col("source").alias(source), "t", bit(LIMITS).alias("limits"), bit(SPIKE).alias("spike"), bit(STUCK).alias("stuck"))


def quote_limits() -> Column:
    """A quote that can't be true: high, low or close not finite and above zero, high below low, close outside them, volume below zero."""
    wrong = F.lit(False)
    for c in ("high", "low", "close"):
        x = F.col(c)
        wrong = wrong | F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0), F.lit(False))
    for c in (F.col("high") < F.col("low"), F.col("close") > F.col("high"), F.col("close") < F.col("low"), F.col("volume") < 0):
        wrong = wrong | F.coalesce(c, F.lit(False))
    return wrong
