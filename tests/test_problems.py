"""The general data problems against brute force on small and random inputs."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators.gridfill import regular_grid
from tidemill.operators.implausible import additive_outliers, autoregression, implausible, stuck_runs, typical_change
from tidemill.operators.readings import latest_rows, quote_readings
from tidemill.operators.rolling import advance, build, correct, current, daily_amounts, spans
from tidemill.operators.sessions import sessions
from tidemill.operators.skew import frequent_values, heavy_keys, salted_aggregate

DAY = datetime.date(2010, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


# readings


def test_latest_rows(spark):
    t = lambda n: datetime.datetime(2010, 1, 1, n)
    rows = [(" ab ", day(0), 1.0, t(1)), ("AB", day(0), 2.0, t(2)), ("AB", day(0), 2.0, t(2)), ("AB", day(1), None, t(3)), ("AB", day(1), 5.0, None), (None, day(1), 5.0, t(1)), ("AB", None, 5.0, t(1))]
    df = spark.createDataFrame(rows, "symbol string, day date, close double, loaded_at timestamp")
    out = sorted((r.symbol, r.day, r.close) for r in quote_readings(df, ["close"]).collect())
    assert out == [("AB", day(0), 2.0), ("AB", day(1), None)]
    assert latest_rows(df.where("false"), ["symbol", "day"], "loaded_at", ["close"]).count() == 0


# regular grid


def grid_model(rows, calendar, max_gap):
    out, by = [], {}
    for s, t, v in rows:
        if s is not None and t is not None and v is not None and v == v:
            by.setdefault(s, {})
            by[s][t] = max(by[s].get(t, float("-inf")), v)
    for s, series in by.items():
        times = sorted(series)
        for g in (c for c in calendar if times[0] <= c <= times[-1]):
            p, n = max(t for t in times if t <= g), min(t for t in times if t >= g)
            if p == g:
                out.append((s, g, series[g], "reading"))
            elif (max_gap is None or n - p <= max_gap) and abs(series[p]) < float("inf") and abs(series[n]) < float("inf"):
                out.append((s, g, series[p] + (series[n] - series[p]) * (g - p) / (n - p), "filled"))
            else:
                out.append((s, g, None, "missing"))
    return out


@pytest.mark.parametrize("chunk", [None, 5, 50])
@pytest.mark.parametrize("with_calendar", [False, True])
def test_regular_grid(spark, chunk, with_calendar):
    rnd = random.Random(chunk or 1)
    rows = [(s, rnd.randrange(200), rnd.choice([1.0, 2.5, float("nan"), None, 7.25, float("inf")])) for s in ("a", "b", "c") for _ in range(25)]
    rows += [("hot", t, float(t)) for t in range(0, 200, 3) for _ in range(3)] + [(None, 5, 1.0), ("a", None, 1.0), ("empty", 9, None), ("one", 12, 3.0)]
    step = 4
    calendar = sorted(rnd.sample(range(200), 60)) if with_calendar else list(range(0, 200, step))
    df = spark.createDataFrame(rows, "source string, time bigint, v double").withColumn("t", F.lit("a clashing name"))
    cal = spark.createDataFrame([(c,) for c in calendar], "c bigint") if with_calendar else None
    kind = {"calendar": cal, "calendar_time": "c", "step": 1} if with_calendar else {"step": step}
    out = regular_grid(df, "source", "time", "v", max_gap=20, chunk=chunk, **kind)
    got = sorted((r.source, r.t, None if r.filled is None else round(r.filled, 9), r.status) for r in out.collect())
    want = sorted((s, t, None if v is None else round(v, 9), st) for s, t, v, st in grid_model(rows, calendar, 20))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert got == want


@pytest.mark.parametrize("chunk", [None, 4_000_000])
@pytest.mark.parametrize("step", [1, 1_000_000])
def test_grid_at_times_of_a_calendar(spark, chunk, step):
    at = lambda us: datetime.datetime(2010, 1, 1) + datetime.timedelta(microseconds=us)
    readings = [("a", at(0), 0.0), ("a", at(10_000_000), 10.0), ("b", at(3_700_000), 1.0), ("b", at(86_400_000_000 * 20), 2.0)]
    calendar = [at(us) for us in (-5, 1_000_000, 3_700_000, 3_700_001, 3_700_001, 9_999_999, 86_400_000_000 * 9 + 7, 86_400_000_000 * 20)]
    df, cal = spark.createDataFrame(readings, "s string, at timestamp_ntz, v double"), spark.createDataFrame([(t,) for t in calendar], "c timestamp_ntz")
    base = int((at(0) - datetime.datetime(1970, 1, 1)).total_seconds()) * 10**6
    # chunks of 4 s only for the short series
    df = df.where("s = 'a'") if chunk else df
    got = sorted((r.s, r.t - base, r.status) for r in regular_grid(df, "s", "at", "v", step=step, calendar=cal, calendar_time="c", chunk=chunk).collect())
    want = [("a", t, "filled") for t in (1_000_000, 3_700_000, 3_700_001, 9_999_999)]
    if not chunk:
        want += [("b", 3_700_000, "reading"), *(("b", t, "filled") for t in (3_700_001, 9_999_999, 86_400_000_000 * 9 + 7)), ("b", 86_400_000_000 * 20, "reading")]
    assert got == want


def test_grid_across_a_long_gap(spark):
    df = spark.createDataFrame([("a", 3, 0.0), ("a", 30_005, 3000.2)], "s string, t bigint, v double")
    for step in (1, 7):
        out = regular_grid(df, "s", "t", "v", step=step, chunk=100).orderBy("t").collect()
        assert [r.t for r in out] == list(range(-(-3 // step) * step, 30_006, step)) and out[-1].filled == pytest.approx((out[-1].t - 3) / 10)


def test_grid_of_dates_and_nothing(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(3), 4.0)], "s string, d date, v double")
    out = [(r.t - 14610, r.filled) for r in regular_grid(df, "s", "d", "v").orderBy("t").collect()]
    assert out == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)]
    assert regular_grid(df.where("false"), "s", "d", "v").count() == 0


# sessions


def session_model(rows, gap):
    out, by = [], {}
    for k, t in rows:
        if k is not None and t is not None:
            by.setdefault(k, []).append(t)
    for k, times in by.items():
        times.sort()
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > gap:
                out.append((k, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((k, start, last, last - start, n))
    return sorted(out)


@pytest.mark.parametrize("share", [0.01, 0.5, 2.0])
def test_sessions(spark, share):
    rnd = random.Random(3)
    rows = [(1, rnd.randrange(3000)) for _ in range(400)] + [(rnd.randrange(2, 40), rnd.randrange(3000)) for _ in range(500)] + [(None, 5), (7, None), (99, 100), (99, 110), (99, 121), (1, 50), (1, 50)]
    df = spark.createDataFrame(rows, "uid bigint, at bigint").withColumn("key", F.lit(1))
    out = sessions(df, "uid", "at", 10, heavy_share=share)
    assert sorted(tuple(r) for r in out.collect()) == session_model(rows, 10)


def test_sessions_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(4)
        rows = [(str(rnd.randrange(6)), rnd.randrange(2000)) for _ in range(600)]
        out = sessions(spark.createDataFrame(rows, "uid string, at bigint"), "uid", "at", 9, heavy_share=0.2)
        assert sorted(tuple(r) for r in out.collect()) == session_model(rows, 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sessions_of_timestamps_and_nothing(spark):
    t = datetime.datetime(2014, 4, 1, 12)
    df = spark.createDataFrame([(1, t), (1, t + datetime.timedelta(minutes=30)), (1, t + datetime.timedelta(minutes=60, microseconds=1))], "uid long, at timestamp_ntz")
    out = sorted((r.start_us, r.end_us, r.n_events) for r in sessions(df, "uid", "at", 1_800_000_000).collect())
    base = int((t - datetime.datetime(1970, 1, 1)).total_seconds()) * 10**6
    assert out == [(base, base + 1_800_000_000, 2), (base + 3_600_000_001, base + 3_600_000_001, 1)]
    assert sessions(df.where("false"), "uid", "at", 5).count() == 0


# implausible readings


def outlier_model(y, factor, longest):
    """Runs that lie on one side of both neighbours, without repetition."""
    d = np.abs(np.diff(y))
    scale = np.median(d[d > 0])
    out = np.zeros(len(y), bool)
    for n in range(1, longest + 1):
        for i in range(1, len(y) - n):
            run, b, a = y[i : i + n], y[i - 1], y[i + n]
            if max(run.min() - max(a, b), min(a, b) - run.max()) > factor * scale:
                out[i : i + n] = True
    return out


def test_additive_outliers():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        y = np.cumsum(rnd.normal(0, 0.01, 300)) + 3
        want = np.zeros(300, bool)
        for i in range(20, 280, 40):
            n = int(rnd.integers(1, 4))
            y[i : i + n] += rnd.choice([-1, 1]) * rnd.uniform(0.5, 3)
            want[i : i + n] = True
        shift = int(rnd.integers(30, 270))
        if not want[shift - 5 : shift + 5].any():
            y[shift:] += 2  # stays: no case
        found = additive_outliers(y, 8.0, 3)
        assert (found == want).all() and (found == outlier_model(y, 8.0, 3)).all()
    busy = np.full(50, 1.0) + np.arange(50) % 2 * 0.01
    busy[20:26] += 3  # too long
    busy[23] += 2  # a spike within
    found = additive_outliers(busy, 8.0, 3)
    assert found.nonzero()[0].tolist() == [23]
    assert not additive_outliers(np.ones(10), 8.0, 3).any() and not additive_outliers(np.zeros(0), 8.0, 3).any()


def test_stuck_runs():
    x = np.arange(100.0)
    x[40:45] = 7.5
    assert stuck_runs(x, 5, 0.05).nonzero()[0].tolist() == list(range(40, 45))
    assert not stuck_runs(np.repeat(np.arange(30.0), 3), 5, 0.05).any()
    often = np.repeat(np.arange(30.0), 2)
    assert not stuck_runs(np.concatenate((often, np.full(6, 99.0))), 5, 0.05).any()


def test_level_shifts_and_the_autoregression():
    rnd = np.random.default_rng(2)
    d = np.zeros(400)
    for k in range(1, 400):  # changes that turn back: the coefficient is far from 0
        d[k] = -0.6 * d[k - 1] + rnd.normal(0, 0.01)
    y = np.cumsum(d) + 3
    phi, scale, _ = autoregression(y, 1.0)
    assert -0.7 < phi < -0.4 and scale == typical_change(y)
    shifted = y.copy()
    shifted[200:] += 1
    assert not additive_outliers(shifted, 8.0, 3).any()
    shifted[100] -= 0.5
    shifted[199:202] += 0.7  # beside the shift
    assert additive_outliers(shifted, 8.0, 3).tolist() == outlier_model(shifted, 8.0, 3).tolist() and additive_outliers(shifted, 8.0, 3)[100]
    # an outlier bends neither coefficient nor scale much
    bent = y.copy()
    bent[50] += 5
    assert abs(autoregression(bent, 1.0)[0] - phi) < 0.05


@pytest.mark.parametrize("chunk", [None, 64, 120])
def test_implausible(spark, chunk):
    rnd = random.Random(5)
    rows = []
    for s in ("a", "b"):
        v = 100.0
        for t in range(400):
            v *= 1 + rnd.uniform(-0.01, 0.01)
            rows.append([s, t, v])
    rows[50][2] *= 3
    rows[130][2] = float("nan")
    for i in range(500, 506):
        rows[i][2] = 55.5
    rows[600][2] = None
    df = spark.createDataFrame([tuple(r) for r in rows] + [(None, 1, 1.0), ("c", 1, 5.0)], "s string, t bigint, v double").withColumn("part", F.lit("x")).withColumn("field", F.lit("y"))
    out = implausible(df, "s", "t", ["v"], F.isnan("v") | (F.col("v") <= 0), {"v": True}, chunk=chunk)
    got = sorted((r.s, r.t, r.limits, r.spike, r.stuck) for r in out.collect())
    assert got == [("a", 50, False, True, False), ("a", 130, True, False, False), *[("b", t, False, False, True) for t in range(100, 106)]]
    assert implausible(df.where("false"), "s", "t", ["v"], F.lit(False), {"v": True}, chunk=chunk).count() == 0


def test_implausible_in_pieces_gives_the_same_rows(spark):
    """Sources with empty stretches, busy times, spikes and runs at the pieces' ends, and one that often repeats a value."""
    rnd = random.Random(6)
    rows = []
    for s, repeats in (("a", 0.0), ("b", 0.02), ("c", 0.3)):
        t, v, w = 0, 100.0, 50.0
        for k in range(700):
            t += 1 if rnd.random() < 0.97 else rnd.randrange(1, 900)  # empty stretches longer than a piece
            v *= 1 + rnd.uniform(-0.01, 0.01) * (5 if 300 < k < 400 else 1)
            w = w if rnd.random() < repeats else w + rnd.choice([-1.5, 0.25, 2.0])
            value = v * rnd.choice([0.2, 4]) if rnd.random() < 0.03 else v
            rows.append((s, t, value, None if rnd.random() < 0.2 else 0.0 if 590 < k < 600 else 77.0 if k in range(127, 133) or k in range(253, 262) else w))
    df = spark.createDataFrame(rows, "s string, t bigint, v double, w double")
    run = lambda chunk: sorted(map(tuple, implausible(df, "s", "t", ["v", "w"], F.col("v") < 25, {"w": False}, chunk=chunk, halo=32).collect()))
    whole = run(None)
    assert {bits for r in whole for bits in [r[2:]]} >= {(False, True, False), (False, False, True)} and run(64) == whole and run(100) == whole


def test_a_spike_after_an_empty_stretch(spark):
    rows = [("a", t, 100.0 + t % 3) for t in range(100)] + [("a", 500, 900.0)] + [("a", t, 100.0 + t % 3) for t in range(501, 600)]
    df = spark.createDataFrame(rows, "s string, t bigint, v double")
    for chunk in (None, 100):
        assert [r.t for r in implausible(df, "s", "t", ["v"], F.lit(False), {}, chunk=chunk).collect()] == [500]


# skew


def test_salted_aggregate(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["hot"] * 8 + ["x", "y", None]), rnd.choice([None, 1, 2, 3, 4]), rnd.choice([0.5, None, 2.5])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, u int, v double").withColumn("salt", F.lit("theirs"))
    kinds = {"n": ("count", None), "nv": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "m": ("avg", "v"), "d": ("distinct", "u"), "dv": ("distinct", "v")}
    got = {r.k: r for r in salted_aggregate(df, ["k"], kinds, salts=8, share=0.05).collect()}
    assert set(got) == {"hot", "x", "y", None}
    for k, r in got.items():
        mine = [x for x in rows if x[0] == k]
        v = [x[2] for x in mine if x[2] is not None]
        assert (r.n, r.nv, r.lo, r.hi) == (len(mine), len(v), min(v), max(v)) and r.s == pytest.approx(sum(v)) and r.m == pytest.approx(sum(v) / len(v))
        assert r.d == len({x[1] for x in mine if x[1] is not None}) and r.dv == len(set(v))
    assert salted_aggregate(df.where("false"), ["k"], kinds).count() == 0
    assert {r.k: r.d for r in salted_aggregate(df, ["k"], {"d": ("distinct", "u")}, share=0.5).collect()} == {k: r.d for k, r in got.items()}
    assert [r.k for r in heavy_keys(df, ["k"], 0.5).collect()] == ["hot"] and heavy_keys(df.where("false"), ["k"]).count() == 0
    assert {r.k: r.heavy_rows for r in heavy_keys(df, ["k"], 1e-6).collect()} == {k: r.n for k, r in got.items()}


def test_frequent_values(spark):
    rows = [("m", "a")] * 6 + [("m", "b")] * 5 + [("m", None)] * 89 + [(None, "a")] * 50 + [("n", " a")] + [("n", "a")]
    df = spark.createDataFrame(rows, "p string, c string")
    out = sorted((r.period, r.col_value) for r in frequent_values(df, F.col("p"), ["c"], 0.05).collect())
    assert out == [("m", "a"), ("n", " a"), ("n", "a")]


# rolling totals


def rolling_model(rows, periods):
    by = {}
    for s, d, v in rows:
        if s is not None and d is not None:
            by.setdefault(s, {}).setdefault(d, []).append(v)
    out = {}
    for s, days in by.items():
        for d in range(min(days), max(days) + 1):
            out[s, d] = tuple(x for p in periods for got in [[v for e in range(d - p + 1, d + 1) for v in days.get(e, []) if v is not None]] for x in (round(sum(got), 6), len(got)))
    return out


def as_map(df, periods):
    return {(r.entity, r.day_no): tuple(x for p in periods for x in (round(float(r[f"v_sum_{p}"]), 6), r[f"v_n_{p}"])) for r in df.collect()}


def test_rolling(spark):
    rnd, periods = random.Random(7), [3, 10]
    base = (DAY - datetime.date(1970, 1, 1)).days
    rows = [(rnd.choice("abc"), base + rnd.randrange(60), rnd.choice([1.5, 2.25, None, -3.0])) for _ in range(90)] + [(None, base, 1.0), ("z", base, None), ("z", base + 1, 1.0)]
    raw = spark.createDataFrame([(s, day(d - base), v) for s, d, v in rows], "s string, d date, v double").withColumn("entity", F.lit("other"))
    daily = daily_amounts(raw, "s", "d", {"v": F.col("v")})
    want = rolling_model(rows, periods)
    for length in (10, 17, 366):
        state = build(daily, periods, length=length)
        assert as_map(state, periods) == want and {r.version for r in state.collect()} == {1}
    # a day, and a stretch of days, from the state of the eve
    known = spans(daily)
    for length, d, until in ((1, base + 30, base + 30), (20, base - base % 20 + 20, base - base % 20 + 39)):
        yesterday = state.where(F.col("day_no") == d - 1).drop("version")
        days = known.select("entity", F.greatest("first_day", F.lit(d)).alias("first_day"), F.least("last_day", F.lit(until)).alias("last_day")).where("first_day <= last_day")
        step = as_map(advance(yesterday, daily.where(F.col("day_no") > d - 1 - max(periods)), days, periods, length), periods)
        assert step == {k: v for k, v in want.items() if d <= k[1] <= until}
    # corrections: more amounts within the days of an entity, and one taken back
    s, e = next((s, e) for s, e in sorted(want) if (s, e + 5) in want)
    more = [(s, e, 4.0), (s, e + 2, -1.5), (s, e + 5, 0.25)]
    changed = daily_amounts(spark.createDataFrame([(s, day(d - base), v) for s, d, v in more], "s string, d date, v double"), "s", "d", {"v": F.col("v")})
    new = correct(state, changed, periods, 2, length=13)
    assert {r.version for r in new.collect()} == {2} and {r.day_no for r in new.collect()} == {d for k, d in want if k == s and e <= d < e + 5 + max(periods)}
    newest = current(state.unionByName(new))
    assert as_map(newest, periods) == rolling_model([*rows, *more], periods) and as_map(current(state, new), periods) == as_map(newest, periods)
    back = changed.select("entity", "day_no", (-F.col("v_sum")).cast("decimal(38,6)").alias("v_sum"), (-F.col("v_n")).alias("v_n"))
    again = current(newest.unionByName(correct(newest, back, periods, 3)))
    assert as_map(again, periods) == want and {r.version for r in again.collect()} == {1, 3}
    assert build(daily.where("false"), periods).count() == 0 and correct(state, changed.where("false"), periods, 2).count() == 0


def test_rolling_whole_amounts(spark):
    raw = spark.createDataFrame([("a", day(0), 2**53 + 1), ("a", day(1), None), ("a", day(2), -5)], "s string, d date, v long")
    state = build(daily_amounts(raw, "s", "d", {"v": F.col("v")}), [2])
    assert [(r.v_sum_2, r.v_n_2) for r in state.orderBy("day_no").collect()] == [(2**53 + 1, 1), (2**53 + 1, 1), (-5, 1)]


def test_rolling_odd_amounts(spark):
    raw = spark.createDataFrame([("a", day(0), float("nan")), ("a", day(1), float("inf")), ("a", day(2), 1e30), ("a", day(3), 2.0)], "s string, d date, v double")
    state = build(daily_amounts(raw, "s", "d", {"v": F.col("v")}), [3])
    assert [(float(r.v_sum_3), r.v_n_3) for r in state.orderBy("day_no").collect()] == [(0, 0), (0, 0), (0, 0), (2.0, 1)]
