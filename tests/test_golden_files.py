"""The known results of each test file, one test a file; exceptions are named where they stand."""

import datetime
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemill.frame import Series
from tidemill.functions import scalar as S
from tidemill.functions import types as ty
from tidemill.operators import agg, dictionary, ranking, reshape, runs, special, tsjoin, udf, windows
from tidemill.sources.store import Store

QUOTES = [
    ("IBM", "2013-11-01", 10.2, 11.0, 10.0, 10.5, 100), ("IBM", "2013-11-02", 20.2, 20.2, 20.2, 20.2, 200), ("IBM", "2013-11-04", 30.5, 31.0, 30.0, 30.2, 300), ("IBM", "2013-11-05", 40.5, 41.0, 40.0, 40.2, 400),
    ("IBM", "2013-11-06", 50.2, 51.0, 50.0, 50.5, 500), ("ABB", "2013-11-03", 60.5, 61.0, 70.0, 60.2, 600), ("ABB", "2013-11-06", 70.2, 71.0, 70.0, 70.5, 700),
]
CRASHES = [
    ("2014-04-14 11:54", 10000001, "USA", "New York", "iPhone4", "wifi", "iOS6.x"), ("2014-04-14 11:55", 10000002, "Japan", "Tokio", "Sony Xperia Z1", "Vodafone 3G", "Android 4.4"),
    ("2014-04-14 11:56", 10000003, "China", "Beijing", "iPhone5", "wifi", "iOS7.x"),
]
day = lambda n: datetime.date(2013, 11, n)
DATE, STAMP = "date", "timestamp_ntz"


@pytest.fixture(scope="module")
def store(spark):
    rows = [(a, datetime.date.fromisoformat(b), *c) for a, b, *c in QUOTES]
    df = spark.createDataFrame(rows, "symbol string, day date, open float, high float, low float, close float, volume int")
    return Store.load(df.repartition(1).cache(), "day", ["symbol"])


@pytest.fixture(scope="module")
def ibm(store):
    s = store.get("IBM").series
    return Series(s.df.cache(), s.ids, s.pos)


@pytest.fixture(scope="module")
def crashes(spark):
    rows = [(datetime.datetime.fromisoformat(a), *b) for a, *b in CRASHES]
    return spark.createDataFrame(rows, "log_time timestamp_ntz, uid long, country string, city string, device string, net string, os string").repartition(1).cache()


def each(df, order="pos", *columns):
    rows = df.orderBy(*([order] if isinstance(order, str) else order)).collect()
    names = columns or [c for c in df.columns if c not in ("symbol", "id", "pos", order)]
    return {c: [r[c] for r in rows] for c in names}


def agree(got, want, tol=1e-6):
    assert set(got) >= set(want)
    for name, values in want.items():
        assert len(got[name]) == len(values), name
        for a, b in zip(got[name], values):
            assert a == b or isinstance(b, (int, float)) and a == pytest.approx(b, rel=tol, abs=tol), (name, got[name], values)


def seq(spark, values, kind="int", name="v"):
    return Series(spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], f"id string, pos bigint, {name} {kind}"), ("id",))


def test_create(store, crashes):
    assert {r.symbol: r.n for r in store.count().collect()} == {"IBM": 5, "ABB": 2}
    assert Store.load(crashes, "log_time").count().first().n == 3


def test_scalarop(ibm):
    out = agg.grand(ibm.df, [], wsum=agg.two("wsum", "volume", "close"), wavg=agg.two("wavg", "volume", "close"), corr=agg.two("corr", "high", "low"), cov=agg.two("cov", "high", "low")).first().asDict()
    assert out == pytest.approx({"wsum": 55480.0006866455, "wavg": 36.9866668294271, "corr": 0.999654253859527, "cov": 201.174396875})


def test_grandagg(spark, store, ibm):
    one = lambda s, kind, c: agg.grand(s, [], r=agg.one(kind, c)).first().r
    kinds = {"sum": ("volume", 1500), "avg": ("volume", 300), "var": ("open", 201.22160451355), "dev": ("close", 14.1428992745525), "count": ("day", 5)}
    for kind, (c, want) in kinds.items():
        assert one(ibm.df, kind, c) == pytest.approx(want)
    assert one(ibm.df.select((F.col("high") - F.col("low")).alias("d")), "prd", "d") == 0 and one(ibm.df.select(S.int_div(F.col("volume"), F.lit(200)).alias("d")), "approxdc", "d") == 3
    assert (store.first("IBM").first().first_ts, store.last("IBM").first().last_ts, store.count("IBM").first().n) == (day(1), day(6), 5)
    some = store.get(["ABB", "IBM"], day(3), day(5)).rows
    assert {r.symbol: r.m for r in agg.grand(some, ["symbol"], m=agg.one("max", "close")).collect()} == pytest.approx({"ABB": 60.2000007629395, "IBM": 40.2000007629395})
    both = {r.symbol: (r.lo, r.mid) for r in agg.grand(store.rows, ["symbol"], lo=agg.one("min", "close"), mid=agg.one("median", "close")).collect()}
    assert both["ABB"] == pytest.approx((60.2000007629395, 65.3499984741211)) and both["IBM"] == pytest.approx((10.5, 30.2000007629395))
    assert one(store.concat(["ABB", "IBM"]).df, "sum", "close") == pytest.approx(282.300003051758)
    assert (one(seq(spark, [1, 2, 3]).df, "sum", "v"), one(seq(spark, [2, 3, 6]).df, "all", "v"), one(seq(spark, [2, 3, 6]).df, "any", "v")) == (6, 2, 7)
    # constants without an end are out of scope: their first four elements are written out
    four = seq(spark, [1, 1, 1, 1])
    assert reshape.filter_pos(four, F.col("v") == 1).agg(F.sum("pos")).first()[0] == 6
    assert four.df.select(windows.cumulative(four, "sum", "v").alias("c")).agg(F.sum("c")).first()[0] == 10


def test_cumagg(ibm):
    want = {
        "max": [10.5, 20.2, 30.2, 40.2, 50.5], "min": [10.5] * 5, "sum": [10.5, 30.7000007629395, 60.9000015258789, 101.100002288818, 151.600002288818], "avg": [10.5, 15.3500003814697, 20.3000005086263, 25.2750005722046, 30.3200004577637],
        "prd": [10.5, 212.100008010864, 6405.42040374756, 257497.9051176, 13003644.2084388], "var": [0, 23.5225078201292, 64.6866720581052, 122.766875371933, 200.021595678711], "dev": [0, 4.85000080619882, 8.04280250025482, 11.0800214517812, 14.1428991256641],
    }
    agree(each(ibm.df.select("pos", *[windows.cumulative(ibm, k, "close").alias(k) for k in want])), want)


def test_gridagg(ibm):
    want = {"max": [20.2, 40.2, 50.5], "min": [10.5, 30.2, 50.5], "sum": [30.7000007629395, 70.4000015258789, 50.5], "avg": [15.3500003814697, 35.2000007629395, 50.5], "var": [23.5225037002565, 25, 0], "dev": [4.85000038146973, 5, 0]}
    agree(each(agg.grid(ibm, 2, **{k: agg.one(k, "close") for k in want}), "cell"), want)


def test_windowagg(ibm):
    want = {
        "max": [10.5, 20.2, 30.2, 40.2, 50.5], "min": [0, 0, 10.5, 20.2, 30.2], "sum": [10.5, 30.7000007629395, 60.9000015258789, 90.6000022888184, 120.900001525879], "avg": [3.5, 10.2333335876465, 20.3000005086263, 30.2000007629395, 40.3000005086263],
        "var": [24.5, 68.0422272915312, 64.6866716512046, 66.6666666666667, 68.6866614786786], "dev": [4.94974746830583, 8.24877125949866, 8.04280247495887, 8.16496580927726, 8.28774163923313],
    }
    whole = Series(ibm.df.select("symbol", "pos", *[windows.window(ibm, k, "close", 3).alias(k) for k in want]), ibm.ids)
    agree(each(whole.df), want)
    agree(each(reshape.cut_head(whole, 2).df), {k: v[2:] for k, v in want.items()})
    agree(each(reshape.limit(whole, 2).df, "pos", "max"), {"max": [30.2, 40.2, 50.5]})
    agree(each(windows.window_ema(ibm, "close", 3).df, "pos", "ema"), {"ema": [10.5, 15.3500003814697, 22.7750005722046, 31.487500667572, 40.993750333786]})
    ranged = ibm.with_column("r", windows.true_range(ibm, "high", "low", "close"))
    agree(each(reshape.cut_head(windows.window_atr(ranged, "r", 3), 2).df, "pos", "atr"), {"atr": [7.16666666666667, 8.37777752346463, 9.18518476132993]})


def test_groupbyagg(spark, ibm):
    thirds = ibm.with_column("k", S.int_div(S.days2000(F.col("day")), F.lit(3)))
    want = {
        "max": [20.2, 40.2, 50.5], "min": [10.5, 30.2, 50.5], "sum": [30.7000007629395, 70.4000015258789, 50.5], "avg": [15.3500003814697, 35.2000007629395, 50.5], "var": [23.5225037002565, 25, 0], "dev": [4.85000038146973, 5, 0],
        "first": [10.5, 30.2, 50.5], "last": [20.2, 40.2, 50.5],
    }
    agree(each(runs.by_run(thirds, ["k"], **{k: (k, "close") for k in want}), "run_id"), want)
    weeks = ibm.with_column("k", S.week(F.col("day")))
    spread = {
        "max": [20.2, 50.5], "min": [10.5, 30.2], "sum": [30.7000007629395, 120.900001525879], "avg": [15.3500003814697, 40.3000005086263], "var": [23.5225037002565, 68.6866614786786], "dev": [4.85000038146973, 8.28774163923313],
        "first": [10.5, 30.2], "last": [20.2, 50.5],
    }
    agree(each(runs.over_run(weeks, ["k"], **{k: (k, "close") for k in spread}).df, "pos", *spread), {k: [a, a, b, b, b] for k, (a, b) in spread.items()})
    keyed = seq(spark, list(zip([3, 1, 6, 7, 0, 3, 6, 5, 2, 3, 7], [1, 1, 1, 2, 2, 3, 3, 4, 5, 5, 5])), "struct<a: bigint, k: int>")
    flat = Series(keyed.df.select("id", "pos", "v.a", "v.k"), ("id",))
    agree(each(runs.by_run(flat, ["k"], all=("all", "a"), any=("any", "a")), "run_id"), {"all": [0, 0, 2, 5, 2], "any": [7, 7, 7, 5, 7]})


def test_hashagg(spark, ibm, crashes):
    odd = F.pmod(S.days2000(F.col("day")), F.lit(2))
    got = {r.k: r for r in agg.by_key(ibm.df.withColumn("k", odd), ["k"], max=agg.one("max", "close"), min=agg.one("min", "close"), sum=agg.one("sum", "close"), avg=agg.one("avg", "close")).collect()}
    assert (got[0].max, got[1].max, got[0].min, got[1].min) == pytest.approx((50.5, 40.2, 20.2, 10.5))
    assert (got[0].sum, got[1].sum, got[0].avg, got[1].avg) == pytest.approx((100.900001525879, 50.7000007629395, 33.6333338419596, 25.3500003814697))
    key = S.cat(a=odd, b=F.col("volume") % 10)
    sums = agg.by_key(ibm.df.withColumn("key", key), ["key"], agg_val=agg.one("sum", "close"))
    assert {tuple(r[:2]): r[2] for r in sums.select(*S.cut(F.col("key"), a="int", b="int"), "agg_val").collect()} == pytest.approx({(1, 0): 50.7000007629395, (0, 0): 100.900001525879})
    assert {tuple(r.p): r.agg_val for r in sums.select(S.as_type(F.col("key"), "struct<first: int, second: int>").alias("p"), "agg_val").collect()} == pytest.approx({(1, 0): 50.7000007629395, (0, 0): 100.900001525879})
    spread = (F.col("high") - F.col("low")) * 10
    assert {r.k: r.n for r in agg.by_key(ibm.df.withColumn("k", S.math("floor", spread)), ["k"], n=F.count("*")).collect()} == {10.0: 4, 0.0: 1}
    dup = agg.dup_count(ibm.df.withColumn("v", S.math("ceil", spread)).withColumn("k", F.pmod(S.days2000(F.col("day")), F.lit(3))), ["k"], "v")
    assert {r.k: r.n for r in dup.collect()} == {1: 1, 0: 1, 2: 2}
    bits = spark.createDataFrame(list(zip([3, 1, 6, 7, 0, 3, 6, 5, 2, 3, 7], [1, 1, 1, 2, 2, 3, 3, 4, 5, 5, 5])), "v int, k int")
    assert {r.k: (r.a, r.o) for r in agg.by_key(bits, ["k"], a=agg.one("all", "v"), o=agg.one("any", "v")).collect()} == {1: (0, 7), 5: (2, 7), 4: (5, 5), 2: (0, 7), 3: (2, 7)}
    words = dictionary.dictionary(crashes, ["country", "device"])
    coded = dictionary.encode(dictionary.encode(crashes, words, "country", "c"), words, "device", "d").withColumn("key", S.cat(c=F.col("c"), d=F.col("d")))
    named = dictionary.decode_key(dictionary.decode_key(agg.by_key(coded, ["key"], n=F.count("*")), words, "key", "c", "country"), words, "key", "d", "device")
    assert {(r.country, r.device, r.n) for r in named.collect()} == {("Japan", "Sony Xperia Z1", 1), ("USA", "iPhone4", 1), ("China", "iPhone5", 1)}


def test_datetime(spark):
    dates = spark.createDataFrame([(0, day(3)), (1, day(6))], "pos int, d date").withColumn("t", ty.cast(F.col("d"), "date", "timestamp"))
    want = {"year": [2013, 2013], "month": [11, 11], "mday": [3, 6], "wday": [0, 3], "week": [722, 722], "quarter": [4, 4]}
    for c in ("d", "t"):
        agree(each(dates.select("pos", *[S.CALENDAR[k](F.col(c)).alias(k) for k in want])), want)
    agree(each(dates.select("pos", "t", *[f(F.col("t")).alias(k) for k, f in S.CLOCK.items()])), {"t": [datetime.datetime(2013, 11, 3), datetime.datetime(2013, 11, 6)], "hour": [0, 0], "minute": [0, 0], "second": [0, 0]})
    row = spark.range(1).select(
        ty.cast(ty.const(datetime.date(2013, 10, 11), "date"), "date", "timestamp").alias("a"), ty.const(datetime.datetime(2013, 10, 11, 10), "timestamp").alias("b"),
        ty.cast(ty.const(datetime.datetime(2013, 10, 11, 10), "timestamp"), "timestamp", "date").alias("c"),
    ).first()
    assert tuple(row) == (datetime.datetime(2013, 10, 11), datetime.datetime(2013, 10, 11, 10), datetime.date(2013, 10, 11))


def test_math(spark, ibm):
    o, c = F.col("open"), F.col("close")
    m = S.math
    agree(
        each(ibm.df.select("pos", m("sqrt", S.power(o - c, F.lit(2.0))).alias("a"), (m("sin", o) * m("sin", o) + m("cos", o) * m("cos", o)).alias("b"), m("atan", m("tan", c)).alias("c"), m("asin", m("sin", c)).alias("d"),
                           m("acos", m("cos", c)).alias("e"), (m("log", m("exp", S.div(c, o))) - S.div(o, c)).alias("f"))),
        {
            "a": [0.300000190734863, 0, 0.299999237060547, 0.299999237060547, 0.299999237060547], "b": [1] * 5, "c": [1.07522203923062, 1.35044484140069, -1.21592577295848, -0.640703733727859, 0.234517542563308],
            "d": [-1.07522203923062, 1.35044484140069, -1.21592577295848, 0.640703733727859, 0.234517542563308], "e": [2.06637061435917, 1.35044484140069, 1.21592577295848, 2.50088891986193, 0.234517542563308],
            "f": [0.0579832196235657, 0, -0.0197697281837463, -0.0148699879646301, 0.0119166374206543],
        },
    )
    assert each(seq(spark, [-1.0, 0.0, 1.0], "double").df.select("pos", F.isnan(S.div(F.col("v"), F.lit(0.0))).alias("n")))["n"] == [False, True, False]


def test_operators(spark, ibm, crashes):
    o, c, h, lo, v = (F.col(x) for x in ("open", "close", "high", "low", "volume"))
    agree(
        each(ibm.df.select("pos", (o + c).alias("plus"), (o - c).alias("minus"), (o * c).alias("times"), S.div(o, c).alias("over"), S.mod(o, c).alias("rest"), S.power(o, c).alias("power"), (-o).alias("neg"), F.abs(o - c).alias("abs"),
                           S.maxof(o, c).alias("hi"), S.minof(o, c).alias("lo"), reshape.norm(ibm, "close").alias("norm"), (v * 2).alias("twice"))),
        {
            "plus": [20.7, 40.4, 60.7, 80.7, 100.7], "minus": [-0.3, 0, 0.299999, 0.299999, -0.299999], "times": [107.1, 408.04, 921.1, 1628.1, 2535.1], "over": [0.971429, 1, 1.00993, 1.00746, 0.994059], "rest": [10.2, 0, 0.299999, 0.299999, 50.2],
            "power": [38931552097.3912, 2.33398999511658e26, 6.6966296391943e44, 4.16574958399165e64, 7.68312765681365e85], "neg": [-10.2, -20.2, -30.5, -40.5, -50.2], "abs": [0.3, 0, 0.299999, 0.299999, 0.299999],
            "hi": [10.5, 20.2, 30.5, 40.5, 50.5], "lo": [10.2, 20.2, 30.2, 40.2, 50.2], "norm": [0.140354513651518, 0.270015360270729, 0.403686325653127, 0.537357291035525, 0.67503837518111], "twice": [200, 400, 600, 800, 1000],
        }, 2e-5,
    )
    flags = {
        "gt": (S.gt(o, c), "00110"), "ge": (S.ge(o, c), "01110"), "lt": (S.lt(o, c), "10001"), "le": (S.le(o, c), "11001"), "eq": (S.eq(o, c), "01000"), "ne": (S.ne(o, c), "10111"), "both": (S.ge(o, c) & S.ne(h, lo), "00110"),
        "any": (S.gt(o, c) | S.eq(h, lo), "01110"), "one": (S.eq(o, c) != S.eq(h, lo), "00000"), "not": (~S.eq(o, c), "10111"), "date": (S.eq(F.col("day"), F.lit(day(1))), "10000"),
    }
    assert {k: "".join(str(int(x)) for x in col) for k, col in each(ibm.df.select("pos", *[f.alias(k) for k, (f, _) in flags.items()])).items()} == {k: want for k, (_, want) in flags.items()}
    assert each(reshape.filter_elements(ibm, S.gt(o, c)).df, "pos", "day")["day"] == [day(4), day(5)] and each(reshape.filter_pos(ibm, S.gt(o, c)), "pos", "pos")["pos"] == [2, 3]
    agree(each(ibm.df.select("pos", F.bitwise_not(v).alias("n"), v.bitwiseAND(1).alias("a"), v.bitwiseOR(1).alias("o"), v.bitwiseXOR(-1).alias("x"))), {"n": [-101, -201, -301, -401, -501], "a": [0] * 5, "o": [101, 201, 301, 401, 501], "x": [-101, -201, -301, -401, -501]})
    # a compound key of two floats is a struct here, not their bytes as text
    s, _ = ty.parse("{1,2,3,4}", "int4")
    four = seq(spark, s)
    agree(each(four.df.select("pos", (F.col("v") + ty.const(3.14, "float4")).alias("a"), (F.col("v") + 10).alias("b"), (F.col("v") + ty.const(2.7, "int4")).alias("c"))), {"a": [4.14, 5.14, 6.14, 7.14], "b": [11, 12, 13, 14], "c": [3, 4, 5, 6]})
    a, b = ty.sequence(spark, "int4:{1,2,3,4}"), ty.sequence(spark, "int4:{10,20,30,40}", name="w")
    assert each(a.join(b, "pos").select("pos", (F.col("v") + F.col("w")).alias("r")))["r"] == [11, 22, 33, 44]
    assert ty.parse("{11-Nov-2013,12-Nov-2013,30-Nov-2013}", "date")[0] == [day(11), day(12), day(30)]
    assert each(reshape.concat(seq(spark, [1, 2, 3]), seq(spark, [4, 5, 6])).df, "pos", "v")["v"] == [1, 2, 3, 4, 5, 6]
    five = seq(spark, [1, 2, 3, 4, 5])
    assert [each(f(five, n).df, "pos", "v")["v"] for f, n in ((reshape.cut_head, 1), (reshape.cut_tail, 2), (reshape.cut_head, 10), (reshape.cut_tail, 10))] == [[2, 3, 4, 5], [1, 2, 3], [], []]
    words = seq(spark, ["Abc", "aaBcc", "aabbcc", "abcba", "aabbabcc", "aabac", "bca"], "string").df
    got = each(words.select("pos", S.like(F.col("v"), "%abc%").cast("int").alias("l"), S.ilike(F.col("v"), "%abc%").cast("int").alias("i"), S.join_strings(F.col("v"), F.lit("!")).alias("j")))
    assert got["l"] == [0, 0, 0, 1, 1, 0, 0] and got["i"] == [1, 1, 0, 1, 1, 0, 0] and got["j"][0] == "Abc!"
    codes = dictionary.dictionary(crashes, ["country", "city", "device", "net", "os"])
    assert dictionary.size(codes).first().n == 14
    assert [r.uid for r in dictionary.encode(crashes, codes, "country", "c").join(codes.where("word = 'USA'"), F.col("c") == F.col("code")).collect()] == [10000001]
    assert sorted(r.uid for r in crashes.where(S.ilike(F.col("device"), "iphone%")).collect()) == [10000001, 10000003]


def test_sort(spark, ibm):
    for smallest, v, at in ((False, [50.5, 40.2, 30.2], [4, 3, 2]), (True, [10.5, 20.2, 30.2], [0, 1, 2])):
        agree(each(ranking.top(ibm, "close", 3, smallest), "place", "close", "pos"), {"close": v, "pos": at})
    for down, at in ((False, [0, 1, 2, 3, 4]), (True, [4, 3, 2, 1, 0])):
        assert each(ranking.sort(ibm, "close", down).df, "pos", "from_pos")["from_pos"] == at
    for values, down, rank, dense in (([1.1, 0.1, 2.2, 0.2, 0.1], False, [4, 1, 5, 3, 1], [3, 1, 4, 2, 1]), ([1.1, 0.2, 2.2, 0.2, 0.1], True, [2, 3, 1, 3, 5], [2, 3, 1, 3, 4])):
        s = seq(spark, values, "double")
        agree(each(s.df.select("pos", ranking.rank(s, "v", down).alias("r"), ranking.rank(s, "v", down, dense=True).alias("d"))), {"r": rank, "d": dense})
    agree(each(ranking.quantiles(ibm, "close", 2), "part", "v"), {"v": [10.5, 30.2, 50.5]})
    assert each(ranking.quantiles(seq(spark, [10, 3, 0, 3, 4, 5, 9, 11, 7, 3, 3]), "v", 2), "part", "v")["v"] == [0, 4, 11]


def test_span(store):
    closes = lambda s: {k: [round(r.close, 1) for r in s.df.where(F.col("symbol") == k).orderBy("pos").collect()] for k in ("ABB", "IBM")}
    ibm, abb = [10.5, 20.2, 30.2, 40.2, 50.5], [60.2, 70.5]
    for first, last, a, b in ((day(2), day(5), abb[:1], ibm[1:4]), (day(2), None, abb, ibm[1:]), (None, day(5), abb[:1], ibm[:4]), (None, None, abb, ibm)):
        assert closes(store.get("IBM", first, last).series) == {"ABB": [], "IBM": b} and closes(store.get(["ABB", "IBM"], first, last).series) == {"ABB": a, "IBM": b}
    for first, last, a, b in ((1, 3, abb[1:], ibm[1:4]), (1, None, abb[1:], ibm[1:]), (0, 3, abb, ibm[:4]), (0, None, abb, ibm)):
        assert closes(store.span("IBM", first, last).series)["IBM"] == b and closes(store.span(["ABB", "IBM"], first, last).series) == {"ABB": a, "IBM": b}


def test_spec(spark, ibm):
    s = seq(spark, [1, 2, 3, 2, 1, 0, 0, 1, 1, 2, 4, 0])
    assert [each(special.extrema(s, "v", k), "pos", "pos")["pos"] for k in (0, 1, -1)] == [[2, 6, 10], [2, 10], [6]]
    assert each(special.histogram(ibm.df, ["symbol"], "close", 0, 100, 10), "bin", "n")["n"] == [0, 1, 1, 1, 1, 1, 0, 0, 0, 0]
    side = lambda t, v=None: spark.createDataFrame([("x", x, i, float(y)) for i, (x, y) in enumerate(zip(t, v or t))], "id string, t bigint, pos bigint, v double")
    left = lambda t: side(t).select("id", "t")
    assert each(tsjoin.stretch(left([1, 2, 3, 4, 5]), side([2, 4], [1.1, 2.2]), ["id"], "t", "v", F.lit(1.0)), "t", "v")["v"] == [1.1, 2.2, 2.2, 1.0, 1.0]
    assert each(tsjoin.stretch0(left([1, 2, 3, 5]), side([2, 3, 4], [1.1, 1.2, 1.3]), ["id"], "t", "v", F.lit(0.0)), "t", "v")["v"] == [0, 1.1, 1.2, 1.3, 0]
    assert each(tsjoin.nearest(tsjoin.neighbours(left([4, 9]), side([1, 3, 6, 10], [0.1, 0.3, 0.6, 1.0]), ["id"], "t", ["v"]), "t", "v", "n"), "t", "n")["n"] == [0.3, 1.0]


def test_transform(spark, store, ibm):
    assert each(ibm.df.select("pos", ty.cast(F.col("volume"), "int4", "float4").alias("f")))["f"] == [100.0, 200.0, 300.0, 400.0, 500.0]
    agree(each(ibm.df.select("pos", reshape.iif(F.col("volume") > 10, F.col("open"), F.col("close")).alias("r"), reshape.diff(ibm, "close").alias("d"))), {"r": [10.2, 20.2, 30.5, 40.5, 50.2], "d": [0, 9.7, 10, 10, 10.3]})
    a = Series(spark.createDataFrame([("IBM", i, i + 1) for i in range(5)], "symbol string, pos bigint, v int"), ("symbol",))
    assert each(reshape.choose(ibm, F.col("open") < F.col("close"), (a, "v"), (a.with_column("v", F.col("v") * 10), "v")), "pos", "chosen")["chosen"] == [1, 10, 20, 30, 2]
    closes = lambda s: [round(x, 1) for x in each(s.df, "pos", "close")["close"]]
    assert [closes(s) for s in (reshape.thin(ibm, 1, 2), reshape.limit(ibm, 1, 3), reshape.head(ibm, 2), reshape.tail(ibm, 2))] == [[20.2, 40.2], [20.2, 30.2, 40.2], [10.5, 20.2], [40.2, 50.5]]
    wide = F.col("high") > F.col("low") * 1.01
    assert [r.day for r in store.get("IBM", None, day(5)).project(reshape.filter_pos(store.get("IBM", None, day(5)).series, wide)).orderBy("day").collect()] == [day(1), day(4), day(5)]
    assert [r.pos for r in reshape.filter_first_pos(ibm, wide, 3).orderBy("pos").collect()] == [0, 2, 3]
    assert each(reshape.unique(ibm.with_column("u", S.int_div(F.col("volume"), F.lit(200))), "u").df, "pos", "u")["u"] == [0, 1, 2]
    assert each(reshape.reverse(ibm).df, "pos", "day")["day"] == [day(6), day(5), day(4), day(2), day(1)]
    assert each(reshape.with_trend(ibm, "close").df, "pos", "trend")["trend"] == [0, 1, 1, 1, 1]
    assert each(reshape.with_trend(seq(spark, [1, 2, 3, 3, 2, 2, 4, 5, 6, 5, 5]), "v").df, "pos", "trend")["trend"] == [0, 1, 1, 1, -1, -1, 1, 1, 1, -1, -1]
    best = ranking.top(ibm, "close", 1).select("symbol", "pos", F.col("place").alias("k"))
    assert [r.volume for r in tsjoin.gather(ibm.df, best, ["symbol"], "pos", "volume").collect()] == [500]
    days = lambda k: store.get(k).rows.select("day")
    assert sorted(r.day for r in reshape.union(days("ABB"), days("IBM"), ["day"]).collect()) == [day(n) for n in range(1, 7)]
    agree(each(ibm.df.select("pos", udf.call(F.col("close").cast("double"), lambda x: x * 2).alias("f"), udf.call(F.col("close").cast("double"), "sin").alias("s"))),
          {"f": [21, 40.4000015258789, 60.4000015258789, 80.4000015258789, 101], "s": [-0.87969575997167, 0.975820684524937, -0.937691475202754, 0.597759755275722, 0.232373761655485]})
    assert ty.to_array(ty.sequence(spark, "int4:{1,2,3,4,5}"), [], "pos", "v").first()["items"] == [1, 2, 3, 4, 5] and ty.to_array(ty.sequence(spark, "bpchar10:{Hello,World,!}"), [], "pos", "v").first()["items"] == ["Hello", "World", "!"]
    assert ty.from_array(spark.createDataFrame([([1, 2, 3, 4, 5],)], "items array<int>"), "items").agg(F.sum("v")).first()[0] == 15
    # the error for an array of another type than the sequence's is Spark's own: arrays have their column's type
    money = ty.sequence(spark, 'money:{100.99,99.01,"$1,000,000"}')
    agree(each(money.select("pos", "v", ty.cast(F.col("v") * 2, "money", "money").alias("t"), ty.cast(F.col("v"), "money", "float8").alias("f"))), {"v": [Decimal("100.99"), Decimal("99.01"), Decimal("1000000.00")], "t": [Decimal("201.98"), Decimal("198.02"), Decimal("2000000.00")], "f": [100.99, 99.01, 1000000.0]})
    assert math.isclose(float(spark.range(1).select(ty.cast(F.lit(99.01).cast("float"), "float4", "money").alias("m")).first().m), 99.01)


def test_drop(store, crashes):
    less = store.delete("IBM", None, day(2))
    assert {r.symbol: r.n for r in less.count().collect()} == {"IBM": 3, "ABB": 2} and each(less.get("IBM").series.df, "pos", "day")["day"] == [day(4), day(5), day(6)]
    assert store.count().agg(F.sum("n")).first()[0] - less.count().agg(F.sum("n")).first()[0] == 2
    assert less.delete("ABB", day(3), day(6)).count("ABB").count() == 0
    gone = less.truncate()
    assert gone.count().count() == 0 and gone.get("IBM").series.df.columns == ["symbol", "day", "open", "high", "low", "close", "volume", "pos"]
    at = lambda m: datetime.datetime(2014, 4, 14, 11, m)
    assert Store.load(crashes, "log_time").delete(None, at(54), at(56)).count().first().n == 0
