"""Small known results of the series operators."""

import datetime
import math
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemill.frame import Series
from tidemill.functions import scalar as S
from tidemill.functions import types as ty
from tidemill.operators import agg, ranking, reshape, runs, special, tsjoin, windows
from tidemill.sources.store import Store

QUOTES = [
    ("IBM", "2013-11-01", 10.2, 11.0, 10.0, 10.5, 100),
    ("IBM", "2013-11-02", 20.2, 20.2, 20.2, 20.2, 200),
    ("IBM", "2013-11-04", 30.5, 31.0, 30.0, 30.2, 300),
    ("IBM", "2013-11-05", 40.5, 41.0, 40.0, 40.2, 400),
    ("IBM", "2013-11-06", 50.2, 51.0, 50.0, 50.5, 500),
    ("ABB", "2013-11-03", 60.5, 61.0, 70.0, 60.2, 600),
    ("ABB", "2013-11-06", 70.2, 71.0, 70.0, 70.5, 700),
]


@pytest.fixture(scope="module")
def quotes(spark):
    rows = [(a, datetime.date.fromisoformat(b), *c) for a, b, *c in QUOTES]
    return spark.createDataFrame(rows, "symbol string, day date, open double, high double, low double, close double, volume int")


@pytest.fixture(scope="module")
def ibm(quotes):
    return Series.of(quotes.where("symbol = 'IBM'"), ["day"], ["symbol"])


def seq(spark, values, kind="double", name="v"):
    cast = float if kind == "double" else int
    return Series(spark.createDataFrame([("x", i, cast(v)) for i, v in enumerate(values)], f"id string, pos bigint, {name} {kind}"), ("id",))


def got(df, column, order="pos"):
    return [r[column] for r in df.orderBy(order).collect()]


def near(a, b, tol=1e-5):
    return len(a) == len(b) and all(x == pytest.approx(y, rel=tol, abs=tol) for x, y in zip(a, b))


def test_trend(spark):
    s = seq(spark, [1, 2, 3, 3, 2, 2, 4, 5, 6, 5, 5], "int")
    assert got(reshape.with_trend(s, "v").df, "trend") == [0, 1, 1, 1, -1, -1, 1, 1, 1, -1, -1]


def test_quantile(spark):
    s = seq(spark, [10, 3, 0, 3, 4, 5, 9, 11, 7, 3, 3])
    assert got(ranking.quantiles(s, "v", 2), "v", "part") == [0, 4, 11]


def test_ranks(spark):
    s = seq(spark, [1.1, 0.1, 2.2, 0.2, 0.1])
    out = s.df.select("pos", ranking.rank(s, "v").alias("r"), ranking.rank(s, "v", dense=True).alias("d"))
    assert got(out, "r") == [4, 1, 5, 3, 1] and got(out, "d") == [3, 1, 4, 2, 1]
    t = seq(spark, [1.1, 0.2, 2.2, 0.2, 0.1])
    out = t.df.select("pos", ranking.rank(t, "v", descending=True).alias("r"))
    assert got(out, "r") == [2, 3, 1, 3, 5]


def test_extrema(spark):
    s = seq(spark, [1, 2, 3, 2, 1, 0, 0, 1, 1, 2, 4, 0], "int")
    assert got(special.extrema(s, "v"), "pos") == [2, 6, 10]
    assert got(special.extrema(s, "v", 1), "pos") == [2, 10]
    assert got(special.extrema(s, "v", -1), "pos") == [6]


def sides(spark, left, right, vals=None):
    a = spark.createDataFrame([("x", t, i) for i, t in enumerate(left)], "id string, t bigint, k int")
    b = spark.createDataFrame([("x", t, i, float(v)) for i, (t, v) in enumerate(zip(right, vals or right))], "id string, t bigint, pos bigint, v double")
    return a, b


def test_stretch(spark):
    a, b = sides(spark, [1, 2, 3, 4, 5], [2, 4], [1.1, 2.2])
    assert got(tsjoin.stretch(a, b, ["id"], "t", "v", F.lit(1.0)), "v", "t") == [1.1, 2.2, 2.2, 1.0, 1.0]
    a, b = sides(spark, [1, 2, 3, 5], [2, 3, 4], [1.1, 1.2, 1.3])
    assert got(tsjoin.stretch0(a, b, ["id"], "t", "v", F.lit(0.0)), "v", "t") == [0, 1.1, 1.2, 1.3, 0]


def test_nearest(spark):
    a, b = sides(spark, [4, 9], [1, 3, 6, 10], [0.1, 0.3, 0.6, 1.0])
    found = tsjoin.neighbours(a, b, ["id"], "t", ["v", "pos"])
    assert got(tsjoin.nearest(found, "t", "v", "near"), "near", "t") == [0.3, 1.0]
    assert got(tsjoin.nearest(found, "t", "pos", "far", farther=True), "far", "t") == [2, 2]
    chunked = tsjoin.neighbours(a, b, ["id"], "t", ["v"], chunk=2)
    assert got(tsjoin.nearest(chunked, "t", "v", "near"), "near", "t") == [0.3, 1.0]


def test_point_join(spark):
    a, b = sides(spark, [1, 3, 4], [1, 3, 5])
    assert got(tsjoin.point(a, b, ["id"], "t", 1), "right_pos", "t") == [0, 1, 2]
    assert got(tsjoin.point(a, b, ["id"], "t", -1), "right_pos", "t") == [0, 1, 1]
    assert got(tsjoin.point(a, b, ["id"], "t", 0, "null"), "right_pos", "t") == [0, 1, None]
    with pytest.raises(Exception, match="no element at time"):
        tsjoin.point(a, b, ["id"], "t", 0).collect()


def test_runs_of_bits(spark):
    rows = list(zip([3, 1, 6, 7, 0, 3, 6, 5, 2, 3, 7], [1, 1, 1, 2, 2, 3, 3, 4, 5, 5, 5]))
    s = Series(spark.createDataFrame([("x", i, v, g) for i, (v, g) in enumerate(rows)], "id string, pos bigint, v bigint, g int"), ("id",))
    out = runs.by_run(s, ["g"], a=("all", "v"), o=("any", "v"), n=("count", "v"))
    assert got(out, "a", "run_id") == [0, 0, 2, 5, 2]
    assert got(out, "o", "run_id") == [7, 7, 7, 5, 7] and got(out, "n", "run_id") == [3, 2, 2, 1, 3]


def test_win_group_sum(spark):
    rows = list(zip(range(1, 11), [1, 1, 1, 2, 2, 3, 3, 3, 3, 4]))
    s = Series(spark.createDataFrame([("x", i, v, g) for i, (v, g) in enumerate(rows)], "id string, pos bigint, v int, g int"), ("id",))
    assert got(runs.over_run(s, ["g"], r=("sum", "v")).df, "r") == [6, 6, 6, 9, 9, 30, 30, 30, 30, 10]


def test_like(spark):
    words = ["Abc", "aaBcc", "aabbcc", "abcba", "aabbabcc", "aabac", "bca"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "pos int, w string")
    out = df.select("pos", S.like(F.col("w"), "%abc%").alias("l"), S.ilike(F.col("w"), "%abc%").alias("i"))
    assert got(out, "l") == [False, False, False, True, True, False, False]
    assert got(out, "i") == [True, True, False, True, True, False, False]
    assert S.pattern("a?_%\\?") == "a_\\_%?"


def test_division(spark):
    df = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 1.0)], "pos int, v double").select("pos", S.div(F.col("v"), F.lit(0.0)).alias("q"))
    q = got(df, "q")
    assert q[0] == -math.inf and math.isnan(q[1]) and q[2] == math.inf
    row = spark.range(1).select(S.int_div(F.lit(-7), F.lit(2)).alias("a"), S.int_mod(F.lit(-7), F.lit(2)).alias("b"), S.int_div(F.lit(1), F.lit(0)).alias("c"), S.log(F.lit(0.0)).alias("d"), S.log(F.lit(-1.0)).alias("e")).first()
    assert (row.a, row.b, row.c, row.d) == (-3, -1, None, -math.inf) and math.isnan(row.e)


def test_compare_nan(spark):
    n = F.lit(float("nan"))
    row = spark.range(1).select(*[f(n, n).alias(k) for k, f in (("eq", S.eq), ("ne", S.ne), ("lt", S.lt), ("ge", S.ge), ("gt", S.gt), ("le", S.le))]).first()
    assert row.asDict() == {"eq": False, "ne": True, "lt": False, "ge": False, "gt": False, "le": False}


def test_literals(spark):
    assert ty.parse('{100.99,99.01,"$1,000,000"}', "money")[0] == [Decimal("100.99"), Decimal("99.01"), Decimal("1000000.00")]
    assert ty.parse("int4:{1,0x10,012}")[0] == [1, 16, 10]
    assert ty.parse("{11-Nov-2013,2013-11-12}", "date")[0] == [datetime.date(2013, 11, 11), datetime.date(2013, 11, 12)]
    assert ty.parse("int4:{}")[0] == [] and ty.parse("bpchar8:{a,b c}") == (["a", "b c"], "bpchar")
    assert ty.promote("int8", "float4") == "float4" and ty.promote("date", "int4") == "date"
    assert got(ty.sequence(spark, "int4:{1,2,3,4}").select("pos", (F.col("v") + ty.const(2.7, "int4")).alias("r")), "r") == [3, 4, 5, 6]
    s = ty.sequence(spark, "int8:{3,1,2}")
    assert ty.to_array(s, [], "pos", "v").first()["items"] == [3, 1, 2]
    assert ty.to_text(s, [], "pos", "v", 2).first()["text"] == "{3,1,...}"
    with pytest.raises(ValueError):
        ty.parse("{1,2}", "nothing")


def test_calendar(spark):
    d = F.lit("2013-11-03").cast("date")
    row = spark.range(1).select(*[f(d).alias(k) for k, f in S.CALENDAR.items()], S.days2000(d).alias("n")).first()
    assert (row.year, row.month, row.mday, row.wday, row.week, row.quarter, row.n) == (2013, 11, 3, 0, 722, 4, 5055)


def test_windows(ibm):
    w = lambda kind: got(ibm.df.select("pos", windows.window(ibm, kind, "close", 3).alias("r")), "r")
    assert w("min") == [0, 0, 10.5, 20.2, 30.2] and w("max") == [10.5, 20.2, 30.2, 40.2, 50.5]
    assert near(w("sum"), [10.5, 30.7, 60.9, 90.6, 120.9]) and near(w("avg"), [3.5, 10.2333, 20.3, 30.2, 40.3], 1e-4)
    pad = [0.0, 0.0, 10.5, 20.2, 30.2, 40.2, 50.5]
    var = lambda x: sum(v * v for v in x) / 3 - (sum(x) / 3) ** 2
    assert near(w("var"), [var(pad[i : i + 3]) for i in range(5)]) and near(w("dev"), [var(pad[i : i + 3]) ** 0.5 for i in range(5)])


def test_averages(ibm):
    ema, acc = [], None
    for v in [10.5, 20.2, 30.2, 40.2, 50.5]:
        acc = v if acc is None else v * 0.5 + acc * 0.5
        ema.append(acc)
    assert near(got(windows.window_ema(ibm, "close", 3).df, "ema"), ema)
    atr, acc = [], 0.0
    for i, v in enumerate([10.5, 20.2, 30.2, 40.2, 50.5]):
        k = min(i + 1, 3)
        acc = (acc * (k - 1) + v) / k
        atr.append(acc)
    assert near(got(windows.window_atr(ibm, "close", 3).df, "atr"), atr)


def test_true_range(ibm):
    ranged = ibm.with_column("r", windows.true_range(ibm, "high", "low", "close"))
    assert near(got(ranged.df, "r"), [1.0, 9.7, 10.8, 10.8, 10.8])
    smooth = reshape.cut_head(windows.window_atr(ranged, "r", 3), 2)
    assert near(got(smooth.df, "atr"), [7.16667, 8.37778, 9.18519], 1e-4)


def test_strength(ibm):
    assert got(windows.strength(ibm, "close", 3).df, "rsi")[1:] == [100.0] * 4


def test_grid_and_cumulative(ibm):
    assert near(got(agg.grid(ibm, 2, r=agg.one("sum", "close")), "r", "cell"), [30.7, 70.4, 50.5])
    assert near(got(ibm.df.select("pos", windows.cumulative(ibm, "sum", "close").alias("r")), "r"), [10.5, 30.7, 60.9, 101.1, 151.6])
    assert got(ibm.df.select("pos", windows.cumulative(ibm, "var", "close").alias("r")), "r")[0] == 0


def test_reshape(ibm):
    assert got(reshape.head(ibm, 2).df, "close") == [10.5, 20.2] and got(reshape.tail(ibm, 2).df, "close") == [40.2, 50.5]
    assert got(reshape.thin(ibm, 1, 2).df, "close") == [20.2, 40.2] and got(reshape.limit(ibm, 1, 3).df, "close") == [20.2, 30.2, 40.2]
    assert got(reshape.cut_head(ibm, 10).df, "close") == [] and got(reshape.cut_tail(ibm, 10).df, "close") == []
    assert got(reshape.reverse(ibm).df, "close") == [50.5, 40.2, 30.2, 20.2, 10.5]
    assert near(got(ibm.df.select("pos", reshape.diff(ibm, "close").alias("r")), "r"), [0, 9.7, 10, 10, 10.3])
    v = ibm.with_column("v", S.int_div(F.col("volume"), F.lit(200)))
    assert got(reshape.unique(v, "v").df, "v") == [0, 1, 2]
    assert near(got(ibm.df.select("pos", reshape.norm(ibm, "close").alias("r")), "r"), [x / math.sqrt(sum(y * y for y in [10.5, 20.2, 30.2, 40.2, 50.5])) for x in [10.5, 20.2, 30.2, 40.2, 50.5]])
    assert got(reshape.repeat(reshape.head(ibm, 2), 2).df, "close") == [10.5, 10.5, 20.2, 20.2]


def test_choose(spark, ibm):
    a = Series(spark.createDataFrame([("IBM", i, v) for i, v in enumerate([1, 2, 3, 4, 5])], "symbol string, pos bigint, v int"), ("symbol",))
    b = a.with_column("v", F.col("v") * 10)
    assert got(reshape.choose(ibm, F.col("open") < F.col("close"), (a, "v"), (b, "v")), "chosen") == [1, 10, 20, 30, 2]


def test_histogram_and_cross(ibm):
    assert got(special.histogram(ibm.df, ["symbol"], "close", 0, 100, 10), "n", "bin") == [0, 1, 1, 1, 1, 1, 0, 0, 0, 0]
    s = ibm.with_column("d", F.col("open") - F.col("close"))
    assert got(special.cross(s, "d"), "pos") == [1, 4]


def test_aggregates(quotes):
    out = {r.symbol: r for r in agg.grand(quotes, ["symbol"], m=agg.one("median", "close"), w=agg.two("wavg", "volume", "close"), v=agg.one("var", "open"), c=agg.two("corr", "high", "low")).collect()}
    assert out["ABB"].m == pytest.approx(65.35) and out["IBM"].m == pytest.approx(30.2)
    assert out["IBM"].w == pytest.approx(sum(c * v for s, _, _, _, _, c, v in QUOTES if s == "IBM") / 1500)
    assert agg.grand(quotes.where("false"), [], s=agg.one("sum", "close"), n=agg.one("count", "close")).first().asDict() == {"s": None, "n": 0}


def test_sets(spark):
    a, b = (spark.createDataFrame([(v,) for v in x], "v int") for x in ([1, 2, 2, 4], [2, 3, 4, 4]))
    assert sorted(r.v for r in reshape.union(a, b, ["v"]).collect()) == [1, 2, 2, 3, 4, 4]
    assert sorted(r.v for r in reshape.intersect(a, b, ["v"]).collect()) == [2, 4]


def test_store(quotes):
    s = Store.load(quotes, "day", ["symbol"])
    d = lambda n: datetime.date(2013, 11, n)
    assert got(s.get("IBM", d(2), d(5)).series.df, "close") == [20.2, 30.2, 40.2]
    assert got(s.get("IBM", None, d(5), 2).series.df, "close") == [30.2, 40.2] and got(s.get("IBM", d(2), None, 2).series.df, "close") == [20.2, 30.2]
    assert got(s.span("IBM", 1, 3).series.df, "close") == [20.2, 30.2, 40.2] and got(s.span("IBM", -2).series.df, "close") == [40.2, 50.5]
    assert got(s.concat(["ABB", "none", "IBM"]).df, "close") == [60.2, 70.5, 10.5, 20.2, 30.2, 40.2, 50.5]
    assert {r.symbol: r.n for r in s.count().collect()} == {"IBM": 5, "ABB": 2}
    assert got(s.delete("IBM", None, d(2)).get("IBM").series.df, "pos") == [0, 1, 2]
    assert s.truncate().series.df.count() == 0
    late = quotes.where("symbol = 'IBM' and day = '2013-11-01'")
    with pytest.raises(Exception, match="out of order"):
        s.append(late).series.df.collect()
    with pytest.raises(Exception, match="null in symbol"):
        Store.load(quotes.withColumn("symbol", F.lit(None).cast("string")), "day", ["symbol"]).series.df.collect()


def test_stream_windows_hold_the_last_day(spark, tmp_path):
    from tidemill.plans import reference

    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    rows = [("x", at(1, 3), 1.0), ("x", at(3, 23), 2.5), ("y", at(3, 1), 4.0), ("x", at(3, 2), None), ("x", None, 9.0), ("x", at(1, 5), 2.0)]
    columns = zip(("event_type", "ts", "value"), (pa.string(), pa.timestamp("us"), pa.float64()), zip(*rows))
    pq.write_table(pa.table({name: pa.array(values, kind) for name, kind, values in columns}), f"{tmp_path}/events.parquet")
    out = sorted((r.event_type, r.start.day, r.n, r.total) for r in reference.queries()["stream_windows"](spark, str(tmp_path)).collect())
    assert out == [("x", 1, 2, 3.0), ("x", 3, 2, 2.5), ("y", 3, 1, 4.0)]


def test_saved_store_comes_back_whole(spark, tmp_path):
    from tidemill.plans import reference

    rows = [(u, datetime.datetime(2024, 1, 1 + k), 1.0, 10 * u + k) for u in (3, 8, 9) for k in (2, 0, 1)]
    columns = zip(("user_id", "ts", "value", "event_id"), (pa.int64(), pa.timestamp("us"), pa.float64(), pa.int64()), zip(*rows))
    pq.write_table(pa.table({name: pa.array(values, kind) for name, kind, values in columns}), f"{tmp_path}/events.parquet")
    out = sorted((r.user_id, r.pos, r.event_id) for r in reference.queries()["store_save_all"](spark, str(tmp_path)).collect())
    assert out == [(u, k, 10 * u + k) for u in (3, 8, 9) for k in range(3)]


def test_slices_are_filters_of_the_scan(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, 1 + d), float(d)) for k in range(5) for d in range(20)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events")
    store = Store.load(spark.read.parquet(f"{tmp_path}/events"), "ts", ["user_id"])
    part = store.get([1, 3], datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 8)).series.df
    plan = part._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "ts" in pushed and "user_id" in pushed and "GreaterThanOrEqual" in pushed and "In(user_id" in pushed
    assert sorted((r.user_id, r.pos, r.value) for r in part.collect()) == [(k, i, 4.0 + i) for k in (1, 3) for i in range(4)]
    # nothing but the rows asked for is read, and what is read has no null ids
    bad = Store.load(spark.read.parquet(f"{tmp_path}/events").withColumn("user_id", F.nullif("user_id", F.lit(2))), "ts", ["user_id"])
    with pytest.raises(Exception, match="null in user_id"):
        bad.get().series.df.collect()


def test_comparisons_of_every_type(spark):
    d, t = datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3)
    rows = [("b", d, t, 2.0, 2), ("a", d.replace(day=3), t.replace(hour=4), math.nan, 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, d date, t timestamp_ntz, x double, n int").coalesce(1)
    for c, other in (("s", F.lit("b")), ("d", F.lit(d)), ("t", F.lit(t).cast("timestamp_ntz")), ("x", F.lit(2.0)), ("n", F.lit(2))):
        got = [tuple(r) for r in df.select(*[f(F.col(c), other) for f in (S.eq, S.ne, S.lt, S.le, S.gt, S.ge)]).collect()]
        second = {"s": (False, True, True, True, False, False), "x": (False, True, False, False, False, False), "n": (False, True, True, True, False, False)}.get(c, (False, True, False, False, True, True))
        assert got == [(True, False, False, True, False, True), second, (None,) * 6], c
    row = spark.range(1).select(S.maxof(F.lit(None).cast("int"), F.lit(1)).alias("a"), S.maxof(F.lit(1), F.lit(None).cast("int")).alias("b"), S.minof(F.lit("x"), F.lit("a")).alias("c"), S.int_mod(F.lit(2**53 + 1), F.lit(2)).alias("d")).first()
    assert tuple(row) == (None, None, "a", 1)


def test_calls_are_counted_and_traced(spark, caplog):
    from tidemill.operators import udf
    from tidemill.plans import reference  # noqa: F401  watches the operators

    udf.profile(spark, reset=True)
    udf.trace(True)
    with caplog.at_level("INFO", logger="tidemill"):
        agg.one("sum", "v")
        agg.one("sum", "v")
    udf.trace(False)
    assert {r.command: r.counter for r in udf.profile(spark, reset=True).collect()} == {"agg.one": 2, "TOTAL": 2} and [r.message for r in caplog.records] == ["agg.one"] * 2
    assert {r.command: r.counter for r in udf.profile(spark).collect()} == {"TOTAL": 0}


def test_types_and_keys(spark):
    df = spark.createDataFrame([(1, 2.0, "a", datetime.date(2024, 1, 1))], "i int, f float, s string, d date")
    assert [ty.type_of(df, c) for c in "ifsd"] == ["int4", "float4", "bpchar", "date"] and [ty.elem_size(df, c) for c in "ifsd"] == [4, 4, None, 4]
    with pytest.raises(ValueError):
        ty.type_of(df.select(F.array("i").alias("a")), "a")
    key = df.select(S.as_type(S.cat(a=F.col("i"), b=F.col("s")), "struct<x: string, y: string>").alias("k")).first().k
    assert (key.x, key.y) == ("1", "a")
    assert df.select(S.join_strings(F.col("s"), F.lit(None).cast("string")).alias("j")).first().j is None


def test_streams_in_several_batches(spark, tmp_path):
    from tidemill.streaming import append

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    lots = [[("a", at(1), 1.0), ("a", at(3), 3.0), ("b", at(5), 7.0), (None, at(1), 1.0)], [("a", at(2), 100.0), ("a", at(3), 5.0), ("a", None, 1.0)], [("b", at(6), 1.0), ("a", at(9), 0.0), ("b", at(4), 50.0)]]
    schema = "k string, ts timestamp_ntz, v double"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for n, lot in enumerate(lots):
        spark.createDataFrame(lot, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        # every run takes up the state of the one before
        store = append.append_to_store(source, f"{tmp_path}/store", f"{tmp_path}/marks", "k", "ts", "v")
    got = {k: [r.v for r in store.get(k).series.df.orderBy("pos").collect()] for k in "ab"}
    assert got == {"a": [1.0, 3.0, 5.0, 0.0], "b": [7.0, 1.0]}
    append.into_table(append.running_state(source, "k", "ts", "v", 2), f"{tmp_path}/out", f"{tmp_path}/marks2")
    rows = {(r.key, r.pos): r for r in spark.read.parquet(f"{tmp_path}/out").collect() if not r.late}
    a = [rows["a", i] for i in range(4)]
    assert [r.running for r in a] == [1, 4, 9, 9] and [r.low for r in a] == [1, 1, 1, 0] and [r.high for r in a] == [1, 3, 5, 5] and near([r["var"] for r in a], [0, 1, 8 / 3, 3.6875])
    assert near([r.ema for r in a], [1, 7 / 3, 37 / 9, 37 / 27]) and near([r.atr for r in a], [1, 2, 3.5, 1.75])
    assert spark.read.parquet(f"{tmp_path}/out").where("late").count() == 2
    append.into_table(append.running_grid(source, "k", "ts", "v", 2), f"{tmp_path}/grid", f"{tmp_path}/marks3")
    assert sorted((r.key, r.cell, r.total) for r in spark.read.parquet(f"{tmp_path}/grid").collect()) == [("a", 0, 4.0), ("a", 1, 105.0), ("b", 0, 57.0)]
