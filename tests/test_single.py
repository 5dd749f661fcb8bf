"""One long series in chunks against a plain model."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.frame import Series
from tidemill.operators import recursive, tsjoin, windows
from tidemill.plans import single


@pytest.mark.parametrize("n", [1, 5, 129, 1000])
def test_chunks(spark, n):
    rnd = random.Random(n)
    order = list(range(n))
    rnd.shuffle(order)
    values = [rnd.choice([0.0, 1.5, -2.25, 7.0]) for _ in range(n)]
    df = spark.createDataFrame([(t, values[t]) for t in order], "t bigint, v double")
    got = {r.t: r for r in single.positions(df, ["t"]).collect()}
    assert all(got[t].pos == t for t in range(n))
    got = {r.t: r.change for r in single.changes(df, ["t"], "v").collect()}
    assert all(got[t] == (values[t] - values[t - 1] if t else 0) for t in range(n))
    for kind, f in (("sum", lambda s: s.cumsum()), ("min", lambda s: s.cummin()), ("max", lambda s: s.cummax())):
        want = f(pd.Series(values)).tolist()
        got = {r.t: r.running for r in single.running(df, ["t"], "v", kind).collect()}
        assert all(got[t] == pytest.approx(want[t]) for t in range(n))
    want = pd.Series(values).ewm(span=10, adjust=False).mean().tolist()
    got = {r.t: r.ema for r in single.moving_average(df, ["t"], "v", 10).collect()}
    assert all(got[t] == pytest.approx(want[t], abs=1e-9) for t in range(n))


def test_scans_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        rnd = random.Random(2)
        rows = [(k, p, rnd.uniform(-5, 5)) for k in "abc" for p in range(rnd.randrange(1, 150))]
        df = spark.createDataFrame(rows, "k string, pos bigint, v double")
        ema = {(r.k, r.pos): r.o for r in recursive.moving_average(df, ["k"], "pos", "v", 4, "o").collect()}
        atr = {(r.k, r.pos): r.o for r in recursive.smoothed_range(df, ["k"], "pos", "v", 4, "o").collect()}
        for key in "abc":
            x = [v for k, _, v in rows if k == key]
            want, acc = pd.Series(x).ewm(span=4, adjust=False).mean().tolist(), 0.0
            for i, v in enumerate(x):
                k = min(i + 1, 4)
                acc = (acc * (k - 1) + v) / k
                assert ema[key, i] == pytest.approx(want[i]) and atr[key, i] == pytest.approx(acc)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("chunk", [None, 3, 40])
@pytest.mark.parametrize("strict", [False, True])
def test_neighbours(spark, chunk, strict):
    rnd = random.Random(chunk)
    left = [(k, rnd.randrange(100), i) for i in range(60) for k in "ab"] + [("c", 5, 1), ("a", None, 2)]
    right = [(k, rnd.randrange(100), i) for i in range(12) for k in "ab"] + [("d", 5, 1)]
    a, b = spark.createDataFrame(left, "k string, t bigint, i int"), spark.createDataFrame(right, "k string, t bigint, v int")
    got = sorted((r.k, r.t, r.i, tuple(r.prev) if r.prev else None, tuple(r.next) if r.next else None) for r in tsjoin.neighbours(a, b, ["k"], "t", ["v"], strict, chunk).collect())
    want = []
    for k, t, i in left:
        if t is not None:
            mine = [(u, v) for q, u, v in right if q == k]
            want.append((k, t, i, max([x for x in mine if x[0] <= t], default=None), min([x for x in mine if (x[0] > t if strict else x[0] >= t)], default=None)))
    assert got == sorted(want, key=lambda x: x[:3]) or sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("strict", [False, True])
def test_neighbours_of_null_ids(spark, strict):
    rnd = random.Random(11)
    ids = [("a", None), (None, None), ("a", "x"), (None, "x")]
    rows = lambda n: [(*k, rnd.randrange(60), i) for i in range(n) for k in ids]
    a, b = spark.createDataFrame([*rows(15), ("l", None, 3, 1)], "k string, q string, t bigint, i int"), spark.createDataFrame(rows(8), "k string, q string, t bigint, v int")
    whole, pieces = (sorted(map(repr, tsjoin.neighbours(a, b, ["k", "q"], "t", ["v"], strict, chunk).collect())) for chunk in (None, 5))
    assert len(whole) == 61 and pieces == whole


def test_series_without_ids(spark):
    s = Series.of(spark.createDataFrame([(3,), (1,), (2,)], "t int"), ["t"])
    assert [(r.t, r.pos) for r in s.df.orderBy("t").collect()] == [(1, 0), (2, 1), (3, 2)]
    assert Series.of(s.df.select("t").where(F.lit(False)), ["t"]).df.count() == 0


def test_chunks_of_a_long_series_among_short_ones(spark):
    rnd = random.Random(9)
    rows = [("hot", t, rnd.choice([0.0, 1.5, -2.25])) for t in range(700)] + [(rnd.choice(["a", "b", "c", None]), t, rnd.choice([1.0, 3.0])) for t in range(300)] + [("one", 1, 5.0)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t bigint, v double").withColumn("u", F.monotonically_increasing_id())
    by = {}
    for r in sorted(df.collect(), key=lambda r: (r.t, r.u)):
        by.setdefault(r.k, []).append(r)
    at = {r.u: (r.k, i) for series in by.values() for i, r in enumerate(series)}
    order, ids = ["t", "u"], ["k"]
    for r in single.positions(df, order, "pos", ids, 6).collect():
        assert at[r.u] == (r.k, r.pos)
    for r in single.changes(df, order, "v", "c", ids, 6).collect():
        k, i = at[r.u]
        assert r.c == (by[k][i].v - by[k][i - 1].v if i else 0)
    want = {k: pd.Series([r.v for r in series]) for k, series in by.items()}
    for kind, f in (("sum", "cumsum"), ("min", "cummin"), ("max", "cummax")):
        model = {k: getattr(s, f)().tolist() for k, s in want.items()}
        for r in single.running(df, order, "v", kind, "x", ids, 6).collect():
            k, i = at[r.u]
            assert r.x == pytest.approx(model[k][i])
    model = {k: s.ewm(span=5, adjust=False).mean().tolist() for k, s in want.items()}
    for r in single.moving_average(df, order, "v", 5, "x", ids, 6).collect():
        k, i = at[r.u]
        assert r.x == pytest.approx(model[k][i], abs=1e-9)
    s = Series.of(df, order, ids, spread=True)
    assert {(r.u, r.pos) for r in s.df.collect()} == {(u, i) for u, (_, i) in at.items()}


@pytest.mark.parametrize("n", [1, 2, 7])
def test_windows_on_pieces(spark, n):
    rnd = random.Random(n)
    rows = [("hot", t, rnd.uniform(-3, 9)) for t in range(500)] + [(k, t, rnd.uniform(-3, 9)) for k in "abc" for t in range(rnd.randrange(1, 40))]
    df = spark.createDataFrame(rows, "k string, t bigint, v double")
    whole = Series.of(df, ["t"], ["k"])
    p = single.pieces(df, ["t"], n - 1, ["k"], 5)
    for kind in ("sum", "avg", "min", "max", "var"):
        want = {(r.k, r.t): r.x for r in whole.df.select("k", "t", windows.window(whole, kind, "v", n).alias("x")).collect()}
        got = {(r.k, r.t): r.x for r in p.df.select("k", "t", "halo", windows.window(p, kind, "v", n).alias("x")).where("not halo").collect()}
        assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_pieces_shorter_than_the_reach(spark):
    df = spark.createDataFrame([(t, float(t)) for t in range(40)], "t bigint, v double")
    with pytest.raises(Exception, match="fewer rows"):
        single.pieces(df, ["t"], 30, (), 8).df.collect()


@pytest.mark.parametrize("n", [0, 3, 400])
def test_ordered_operators_in_chunks(spark, n):
    """A long series among short ones, null ids among them, against plain models; ties and plateaus."""
    rnd = random.Random(n)
    rows = [("hot", t, rnd.choice([0.0, 1.5, 1.5, -2.25])) for t in range(n)] + [(k, t, rnd.choice([1.0, 3.0])) for t in range(n // 8) for k in ("a", "b", None)] + [("one", 1, 5.0)] * (n > 0)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t bigint, v double").withColumn("chunk0", F.lit(1))
    by = {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(k, []).append((t, v))
    order, ids, chunks = ["t"], ["k"], 5
    rows_of = lambda out, c: {(r.k, r.t): r[c] for r in out.collect()}

    def model(f):
        return {(k, t): x for k, series in by.items() for (t, _), x in zip(series, f([v for _, v in series]))}

    new = lambda v: [i == 0 or v[i] != v[i - 1] for i in range(len(v))]
    assert rows_of(single.runs(df, order, "v", "x", ids, chunks), "x") == model(lambda v: (pd.Series(new(v)).cumsum() - 1).tolist())
    assert set(rows_of(single.unique(df, order, "v", ids, chunks), "v")) == {i for i, x in model(new).items() if x}

    def trend(v):
        out = [0] * len(v)
        for i in range(1, len(v)):
            d = v[i] - v[i - 1]
            out[i] = (d > 0) - (d < 0) or out[i - 1]
        return out

    assert rows_of(single.trend(df, order, "v", "x", ids, chunks), "x") == model(trend)
    for down in (False, True):
        rank = lambda v, how: pd.Series(v).rank(method=how, ascending=not down).astype(int).tolist()  # noqa: B023, E731
        assert rows_of(single.ranks(df, "v", "x", down, False, ids, chunks), "x") == model(lambda v: rank(v, "min"))  # noqa: B023
        assert rows_of(single.ranks(df, "v", "x", down, True, ids, chunks), "x") == model(lambda v: rank(v, "dense"))  # noqa: B023
        placed = single.positions(df, order, "pos", ids, chunks)
        at = {k: sorted(range(len(s)), key=lambda i: (-s[i][1] if down else s[i][1], i)) for k, s in by.items()}  # noqa: B023
        assert {(r.k, r.pos): r.from_pos for r in single.sort(placed, "v", "pos", down, ids, chunks).collect()} == {(k, p): i for k, a in at.items() for p, i in enumerate(a)}
    for q in (1, 4):
        want = {(k, p): sorted(v for _, v in s)[len(s) * p // q if p < q else len(s) - 1] for k, s in by.items() for p in range(q + 1)}
        assert {(r.k, r.part): r.v for r in single.quantiles(df, "v", q, ids, chunks).collect()} == want
    near = lambda got, want: set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    for kind, f in (("avg", lambda s: s.expanding().mean()), ("var", lambda s: s.expanding().var(ddof=0)), ("dev", lambda s: s.expanding().std(ddof=0)), ("prd", lambda s: s.cumprod())):
        scaled = df.withColumn("v", 1 + F.col("v") / 1000)
        assert near(rows_of(single.running(scaled, order, "v", kind, "x", ids, chunks), "x"), model(lambda v: f(1 + pd.Series(v) / 1000).tolist())), kind  # noqa: B023

    def smooth(v):
        out, acc = [], 0.0
        for i, x in enumerate(v):
            k = min(i + 1, 6)
            acc = (acc * (k - 1) + x) / k
            out.append(acc)
        return out

    assert near(rows_of(single.smoothed_range(df, order, "v", 6, "x", ids, chunks), "x"), model(smooth))


def test_averages_without_ids_are_spread(spark):
    rows = [(t, float(t % 7)) for t in range(90)]
    s = Series.of(spark.createDataFrame(rows, "t bigint, v double"), ["t"])
    want = pd.Series([v for _, v in rows]).ewm(span=5, adjust=False).mean()
    ema = windows.window_ema(s, "v", 5).df
    assert {r.pos: r.ema for r in ema.collect()} == pytest.approx(dict(enumerate(want)))
    assert "coalesce" not in ema._jdf.queryExecution().toString().lower().replace("coalesce(", "")
    acc, atr = 0.0, {r.pos: r.atr for r in windows.window_atr(s, "v", 5).df.collect()}
    for i, (_, v) in enumerate(rows):
        k = min(i + 1, 5)
        acc = (acc * (k - 1) + v) / k
        assert atr[i] == pytest.approx(acc)


def test_traces_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, t, float(t * t % 11)) for k, n in (("a", 40), ("b", 1), ("c", 7), (None, 8)) for t in range(n)]
        df = spark.createDataFrame(rows, "k string, t bigint, v double")
        for chunks in (1, 3):
            assert {(r.k, r.t): (r.pos) for r in single.positions(df, ["t"], "pos", ["k"], chunks).collect()} == {(k, t): t for k, t, _ in rows}
            v = {(k, t): x for k, t, x in rows}
            assert {(r.k, r.t): r.change for r in single.changes(df, ["t"], "v", "change", ["k"], chunks).collect()} == {(k, t): x - v[k, t - 1] if t else 0 for k, t, x in rows}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
