"""Queries of the series operators over the test tables, each with the same in SQL.

``events`` has one series per user in order of its unique time; ``orders`` one per
customer in order of date and key; ``lineitem`` is only aggregated. Computed
doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Series
from ..functions import scalar as S
from ..functions import types as ty
from ..functions.timeaxis import micros
from ..operators import agg, dictionary, ranking, reshape, runs, special, tsjoin, udf, windows
from ..operators.readings import quote_readings
from ..sources.store import Store
from . import single
from .cut import new_folder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(spark: SparkSession, folder: str, *columns: str) -> Series:
    return Series.of(_table(spark, folder, "events").select("user_id", "ts", *(columns or ("value",))), ["ts"], ["user_id"])


def _orders(spark: SparkSession, folder: str) -> Series:
    return Series.of(_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_orderdate", "o_orderkey"], ["o_custkey"])


#: Added before rounding where results often lie halfway between two rounded values, so that both sides go up.
HALF = 1e-7


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


E = "with e as (select *, row_number() over (partition by user_id order by ts) - 1 as pos from events)"
O = "with o as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as pos from orders)"
W = "window w as (partition by user_id order by pos)"

# whole series

_GRAND = {
    "count": "count(value)", "max": "max(value)", "min": "min(value)", "sum": "round(sum(value), 6)", "avg": "round(avg(value), 6)", "var": "round(var_pop(value), 4)",
    "dev": "round(stddev_pop(value), 6)", "median": "round(median(value), 6)", "prd": "round(product(1 + value / 1000), 6)", "all": "bit_and(event_id)", "any": "bit_or(event_id)",
}
for _kind, _sql in _GRAND.items():

    def _grand(spark, folder, kind=_kind):
        df = _table(spark, folder, "events")
        col = F.col("event_id") if kind in ("all", "any") else 1 + F.col("value") / 1000 if kind == "prd" else F.col("value")
        c = agg.one(kind, col)
        c = F.round(c, 4) if kind == "var" else r6(c) if kind in ("sum", "avg", "dev", "median", "prd") else c
        return agg.grand(df, ["user_id"], result=c)

    query(f"grand_{_kind}", f"select user_id, {_sql} as result from events group by user_id")(_grand)


#: Three standard errors of the approximate counts.
APPROX = 0.27


def _near(exact: str) -> Column:
    """Whether an approximate count lies within three errors of the exact one, and not further than 2 for small ones."""
    return F.abs(F.col("result") - F.col(exact)) <= F.greatest(F.lit(APPROX) * F.col(exact), F.lit(2.0))


@query("grand_approxdc", "select user_id, count(distinct floor(value)) as exact, true as near from events group by user_id")
def _(spark, folder):
    out = agg.grand(_table(spark, folder, "events"), ["user_id"], result=agg.one("approxdc", F.floor("value")), exact=F.count_distinct(F.floor("value")))
    return out.select("user_id", "exact", _near("exact").alias("near"))


_TWO = {
    "wsum": "round(sum(l_quantity * l_extendedprice), 2)", "wavg": "round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6)",
    "cov": "round(covar_pop(l_quantity, l_extendedprice), 3)", "corr": "round(corr(l_quantity, l_extendedprice), 6)",
}
for _kind, _sql in _TWO.items():

    def _two(spark, folder, kind=_kind):
        c = agg.two(kind, "l_quantity", "l_extendedprice")
        return agg.grand(_table(spark, folder, "lineitem"), ["l_suppkey"], result=F.round(c, {"wsum": 2, "cov": 3}.get(kind, 6)))

    query(_kind, f"select l_suppkey, {_sql} as result from lineitem group by l_suppkey")(_two)


def vwap(spark: SparkSession, folder: str) -> DataFrame:
    """Price weighted by volume per series."""
    return agg.grand(_table(spark, folder, "lineitem"), ["l_suppkey"], vwap=r6(agg.two("wavg", "l_quantity", "l_extendedprice")))


query("vwap_by_supplier", "select l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) as vwap from lineitem group by l_suppkey")(vwap)


@query("vwap_whole", "select round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) as vwap from lineitem")
def _(spark, folder):
    return agg.grand(_table(spark, folder, "lineitem"), [], vwap=r6(agg.two("wavg", "l_quantity", "l_extendedprice")))


@query("vwap_range", "select l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) as vwap from lineitem where l_shipdate between timestamp '1997-01-01' and timestamp '1997-03-31' group by l_suppkey")
def _(spark, folder):
    store = Store.load(_table(spark, folder, "lineitem"), "l_shipdate", ["l_suppkey"])
    return agg.grand(store.get(None, _ntz("1997-01-01"), _ntz("1997-03-31")).rows, ["l_suppkey"], vwap=r6(agg.two("wavg", "l_quantity", "l_extendedprice")))


# keys

_HASH = {
    "count": "count(value)", "max": "max(value)", "min": "min(value)", "sum": "round(sum(value), 4)", "avg": "round(avg(value), 6)", "all": "bit_and(event_id)", "any": "bit_or(event_id)",
}
for _kind, _sql in _HASH.items():

    def _hash(spark, folder, kind=_kind):
        c = agg.one(kind, "event_id" if kind in ("all", "any") else "value")
        return agg.by_key(_table(spark, folder, "events"), ["event_type"], result=F.round(c, 4) if kind == "sum" else r6(c) if kind == "avg" else c)

    query(f"hash_{_kind}", f"select event_type, {_sql} as result from events group by event_type")(_hash)


@query("hash_approxdc", "select event_type, count(distinct user_id) as exact, true as near from events group by event_type")
def _(spark, folder):
    out = agg.by_key(_table(spark, folder, "events"), ["event_type"], result=agg.one("approxdc", "user_id"), exact=F.count_distinct("user_id"))
    return out.select("event_type", "exact", _near("exact").alias("near"))


@query("hash_dup_count", "select event_type, count(*) filter (n >= 3) as result from (select event_type, user_id, count(*) as n from events group by event_type, user_id) group by event_type")
def _(spark, folder):
    return agg.dup_count(_table(spark, folder, "events"), ["event_type"], "user_id", 3, "result")


@query("hash_compound_key", "select l_returnflag, l_linestatus, count(*) as n, ascii(l_returnflag) as flag_code, round(sum(l_quantity), 2) as qty from lineitem group by l_returnflag, l_linestatus")
def _(spark, folder):
    keyed = _table(spark, folder, "lineitem").withColumn("key", S.cat(a=F.col("l_returnflag"), b=F.col("l_linestatus")))
    out = agg.by_key(keyed, ["key"], n=F.count("*"), qty=F.round(F.sum("l_quantity"), 2))
    parts = S.cut(F.col("key"), a="string", b="string")
    return out.select(parts[0].alias("l_returnflag"), parts[1].alias("l_linestatus"), "n", F.ascii(S.as_array(F.col("key"), ["a", "b"])[0]).alias("flag_code"), "qty")


@query(
    "q1_hash",
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 6) as avg_qty, round(avg(l_extendedprice), 6) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""",
)
def _(spark, folder):
    rows = _table(spark, folder, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    price, net = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    two = lambda c: F.round(F.sum(c), 2)
    return agg.by_key(
        rows, ["l_returnflag", "l_linestatus"], sum_qty=two(F.col("l_quantity")), sum_base_price=two(price), sum_disc_price=two(net), sum_charge=two(net * (1 + F.col("l_tax"))),
        avg_qty=r6(F.avg("l_quantity")), avg_price=r6(F.avg(price)), avg_disc=r6(F.avg("l_discount")), count_order=F.count("*"),
    )


@query("top_average", "select o_custkey, round(avg(o_totalprice), 6) as ac from orders group by o_custkey order by avg(o_totalprice) desc, o_custkey limit 5")
def _(spark, folder):
    means = agg.by_key(_table(spark, folder, "orders"), ["o_custkey"], m=F.avg("o_totalprice"))
    return means.orderBy(F.col("m").desc(), "o_custkey").limit(5).select("o_custkey", r6("m").alias("ac"))


# runs

_RUNS = f"{E}, r as (select *, sum(new) over (partition by user_id order by pos rows unbounded preceding) - 1 as run_id from (select *, case when event_type is not distinct from lag(event_type) over w and pos > 0 then 0 else 1 end as new from e {W}))"
_RUN = {
    "max": "max(value)", "min": "min(value)", "first": "arg_min(value, pos)", "last": "arg_max(value, pos)", "sum": "round(sum(value), 6)", "avg": "round(avg(value), 6)", "var": "round(var_pop(value) + 1e-7, 4)",
    "dev": "round(stddev_pop(value), 4)", "all": "bit_and(event_id)", "any": "bit_or(event_id)", "count": "count(value)",
}


def _rounded(kind: str, name: str) -> Column:
    return F.round(F.col(name) + HALF, 4) if kind == "var" else F.round(name, 4) if kind == "dev" else r6(name) if kind in ("sum", "avg") else F.col(name)


for _kind, _sql in _RUN.items():

    def _run(spark, folder, kind=_kind):
        s = _events(spark, folder, "value", "event_id", "event_type")
        out = runs.by_run(s, ["event_type"], result=(kind, "event_id" if kind in ("all", "any") else "value"))
        return out.withColumn("result", _rounded(kind, "result"))

    query(f"group_{_kind}", f"{_RUNS} select user_id, run_id, {_sql} as result from r group by user_id, run_id")(_run)
    if _kind == "count":
        continue

    def _win_run(spark, folder, kind=_kind):
        s = _events(spark, folder, "value", "event_id", "event_type")
        out = runs.over_run(s, ["event_type"], result=(kind, "event_id" if kind in ("all", "any") else "value"))
        return out.df.select("user_id", "pos", _rounded(kind, "result").alias("result"))

    _inner = {"first": "min_by(value, pos)", "last": "max_by(value, pos)"}.get(_kind, _sql.replace("round(", "").replace(" + 1e-7", "").split(",")[0] if _sql.startswith("round(") else _sql)
    _over = f"{_inner} over (partition by user_id, run_id)"
    _shown = f"round({_over}{' + 1e-7' if _kind == 'var' else ''}, {4 if _kind in ('var', 'dev') else 6})" if _sql.startswith("round(") else _over
    query(f"win_group_{_kind}", f"{_RUNS} select user_id, pos, {_shown} as result from r")(_win_run)


@query("group_approxdc", f"{_RUNS} select user_id, run_id, count(distinct value) as exact, true as near from r group by user_id, run_id")
def _(spark, folder):
    out = runs.by_run(_events(spark, folder, "value", "event_type"), ["event_type"], result=("approxdc", "value"), exact=("distinct", "value"))
    return out.select("user_id", "run_id", "exact", _near("exact").alias("near"))


# stretches of equal length

for _kind in ("max", "min", "avg", "sum", "var", "dev"):

    def _grid(spark, folder, kind=_kind):
        s = _events(spark, folder)
        return agg.grid(s, 7, result=F.round(agg.one(kind, "value"), 4))

    _f = {"var": "var_pop", "dev": "stddev_pop"}.get(_kind, _kind)
    query(f"grid_{_kind}", f"{E} select user_id, pos // 7 as cell, round({_f}(value), 4) as result from e group by user_id, pos // 7")(_grid)

# moving windows

_N = 5
_FRAME = f"over (partition by user_id order by pos rows between {_N - 1} preceding and current row)"
_WINDOW = {
    "sum": f"sum(value) {_FRAME}", "avg": f"sum(value) {_FRAME} / {_N}",
    "var": f"sum(value * value) {_FRAME} / {_N} - power(sum(value) {_FRAME} / {_N}, 2)", "dev": f"sqrt(greatest(sum(value * value) {_FRAME} / {_N} - power(sum(value) {_FRAME} / {_N}, 2), 0))",
    "min": f"case when pos < {_N - 1} then least(min(value) {_FRAME}, 0) else min(value) {_FRAME} end", "max": f"case when pos < {_N - 1} then greatest(max(value) {_FRAME}, 0) else max(value) {_FRAME} end",
}
for _kind, _sql in _WINDOW.items():

    def _window(spark, folder, kind=_kind):
        s = _events(spark, folder)
        return s.df.select("user_id", "pos", F.round(windows.window(s, kind, "value", _N), 4).alias("result"))

    query(f"window_{_kind}", f"{E} select user_id, pos, round({_sql}, 4) as result from e")(_window)

_EMA = f"""with recursive e as (select user_id, value, row_number() over (partition by user_id order by ts) - 1 as pos from events),
m as (select user_id, pos, value::double as ema from e where pos = 0 union all select e.user_id, e.pos, e.value * 2.0 / {_N + 1} + m.ema * (1 - 2.0 / {_N + 1}) from m join e on e.user_id = m.user_id and e.pos = m.pos + 1)"""


@query("window_ema", f"{_EMA} select user_id, pos, round(ema, 6) as result from m")
def _(spark, folder):
    out = windows.window_ema(_events(spark, folder).with_column("value", F.col("value").cast("double")), "value", _N, "result")
    return out.df.select("user_id", "pos", r6("result").alias("result"))


@query(
    "window_atr",
    f"""with recursive e as (select user_id, value, row_number() over (partition by user_id order by ts) - 1 as pos from events),
    m as (select user_id, pos, value::double as a from e where pos = 0 union all
          select e.user_id, e.pos, (m.a * (least(e.pos + 1, {_N}) - 1) + e.value) / least(e.pos + 1, {_N}) from m join e on e.user_id = m.user_id and e.pos = m.pos + 1)
    select user_id, pos, round(a, 6) as result from m""",
)
def _(spark, folder):
    out = windows.window_atr(_events(spark, folder), "value", _N, "result")
    return out.df.select("user_id", "pos", r6("result").alias("result"))


@query("window_complete", f"{E} select user_id, pos - {_N - 1} as pos, round(s, 4) as result from (select user_id, pos, sum(value) {_FRAME} as s from e) where pos >= {_N - 1}")
def _(spark, folder):
    s = _events(spark, folder)
    whole = reshape.cut_head(s.with_column("result", F.round(windows.window(s, "sum", "value", _N), 4)), _N - 1)
    return whole.keep("result")


@query(
    "strength_index",
    f"""with recursive e as (select user_id, value, row_number() over (partition by user_id order by ts) - 1 as pos from events),
    d as (select user_id, pos, coalesce(value - lag(value) over (partition by user_id order by pos), 0) as d from e),
    m as (select user_id, pos, greatest(d, 0)::double as g, greatest(-d, 0)::double as l from d where pos = 0 union all
          select d.user_id, d.pos, greatest(d.d, 0) * 2.0 / 15 + m.g * (1 - 2.0 / 15), greatest(-d.d, 0) * 2.0 / 15 + m.l * (1 - 2.0 / 15) from m join d on d.user_id = m.user_id and d.pos = m.pos + 1)
    select user_id, pos, case when l = 0 and g = 0 then 'NaN'::double when l = 0 then 100 else round(100 - 100 / (1 + g / l), 6) end as rsi from m""",
)
def _(spark, folder):
    out = windows.strength(_events(spark, folder), "value", 14)
    return out.df.select("user_id", "pos", r6("rsi").alias("rsi"))




def _quotes(spark, folder) -> Series:
    """Readings of the quotes with finite prices, in order of day."""
    rows = quote_readings(_table(spark, folder, "quotes"), ["open", "high", "low", "close", "volume"])
    fine = F.lit(True)
    for c in ("open", "high", "low", "close"):
        rows = rows.withColumn(c, F.col(c).cast("double"))
        fine = fine & F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)
    return Series.of(rows.where(fine & F.col("volume").isNotNull()), ["day"], ["symbol"])


_QUOTES = """with recursive r as (select upper(trim(symbol)) as symbol, day, open::double as open, high::double as high, low::double as low, close::double as close, volume from quotes where symbol is not null and day is not null
    qualify row_number() over (partition by upper(trim(symbol)), day order by loaded_at desc nulls last, open desc nulls last, high desc nulls last, low desc nulls last, close desc nulls last, volume desc nulls last) = 1),
q as (select *, row_number() over (partition by symbol order by day) - 1 as pos from r where isfinite(open) and isfinite(high) and isfinite(low) and isfinite(close) and volume is not null)"""


@query("quotes_vwap", f"{_QUOTES} select symbol, round(sum(volume * close) / sum(volume), 4) as vwap, count(*) as n from q group by symbol having sum(volume) <> 0")
def _(spark, folder):
    s = _quotes(spark, folder)
    return agg.grand(s.df, ["symbol"], total=F.sum("volume"), vwap=F.round(agg.two("wavg", "volume", "close"), 4), n=F.count("*")).where("total <> 0").drop("total")


@query("quotes_growth_days", f"{_QUOTES} select symbol, pos, strftime(day, '%Y-%m-%d') as day from q where close > open * 1.01")
def _(spark, folder):
    s = _quotes(spark, folder)
    days = s.with_column("d", F.date_format("day", "yyyy-MM-dd"))
    return days.df.where(F.col("close") > F.col("open") * 1.01).select("symbol", "pos", F.col("d").alias("day"))


@query(
    "quotes_true_range",
    f"""{_QUOTES}, t as (select symbol, pos, greatest(high - low, coalesce(greatest(abs(high - lag(close) over w), abs(low - lag(close) over w)), 0)) as r from q window w as (partition by symbol order by pos)),
    m as (select symbol, pos, r as a from t where pos = 0 union all select t.symbol, t.pos, (m.a * (least(t.pos + 1, 14) - 1) + t.r) / least(t.pos + 1, 14) from m join t on t.symbol = m.symbol and t.pos = m.pos + 1)
    select symbol, pos - 13 as pos, round(a, 4) as result from m where pos >= 13""",
)
def _(spark, folder):
    s = _quotes(spark, folder)
    ranged = s.with_column("r", windows.true_range(s, "high", "low", "close"))
    smooth = reshape.cut_head(windows.window_atr(ranged, "r", 14, "result"), 13)
    return smooth.df.select("symbol", "pos", F.round("result", 4).alias("result"))


@query("quotes_quintiles", f"{_QUOTES}, k as (select symbol, close, row_number() over (partition by symbol order by close) - 1 as k, count(*) over (partition by symbol) as n from q), p as (select *, unnest([0, 1, 2, 3, 4, 5]) as part from k) select symbol, part, close as v from p where (part < 5 and k = n * part // 5) or (part = 5 and k = n - 1)")
def _(spark, folder):
    return ranking.quantiles(_quotes(spark, folder), "close", 5)


# running aggregates

for _kind in ("max", "min", "sum", "avg", "var", "dev", "prd"):

    def _cum(spark, folder, kind=_kind):
        s = _events(spark, folder)
        if kind == "prd":
            s = s.with_column("value", 1 + F.col("value") / 1000)
        return s.df.select("user_id", "pos", F.round(windows.cumulative(s, kind, "value") + HALF, 4).alias("result"))

    _f = {"var": "var_pop(value)", "dev": "stddev_pop(value)", "prd": "product(1 + value / 1000)"}.get(_kind, f"{_kind}(value)")
    query(f"cum_{_kind}", f"{E} select user_id, pos, round({_f} over (partition by user_id order by pos rows unbounded preceding) + 1e-7, 4) as result from e")(_cum)

# order statistics


@query("sort", f"{O} select o_custkey, row_number() over (partition by o_custkey order by o_totalprice, pos) - 1 as pos, o_totalprice from o")
def _(spark, folder):
    return ranking.sort(_orders(spark, folder), "o_totalprice").keep("o_totalprice")


@query("sort_pos", f"{O} select o_custkey, row_number() over (partition by o_custkey order by o_totalprice desc, pos) - 1 as pos, pos as from_pos from o")
def _(spark, folder):
    return ranking.sort(_orders(spark, folder), "o_totalprice", descending=True).keep("from_pos")


@query("rank", f"{E} select user_id, pos, rank() over (partition by user_id order by floor(value / 10)) as result from e")
def _(spark, folder):
    s = _events(spark, folder).with_column("v", F.floor(F.col("value") / 10))
    return s.df.select("user_id", "pos", ranking.rank(s, "v").alias("result"))


@query("dense_rank", f"{E} select user_id, pos, dense_rank() over (partition by user_id order by floor(value / 10) desc) as result from e")
def _(spark, folder):
    s = _events(spark, folder).with_column("v", F.floor(F.col("value") / 10))
    return s.df.select("user_id", "pos", ranking.rank(s, "v", descending=True, dense=True).alias("result"))


@query(
    "quantile",
    """with k as (select user_id, value as v, row_number() over (partition by user_id order by value) - 1 as k, count(*) over (partition by user_id) as n from events),
    p as (select *, unnest([0, 1, 2, 3, 4, 5]) as part from k) select user_id, part, v from p where (part < 5 and k = n * part // 5) or (part = 5 and k = n - 1)""",
)
def _(spark, folder):
    return ranking.quantiles(_events(spark, folder), "value", 5)


for _kind, _dir in (("top_max", "desc"), ("top_min", "asc")):

    def _top(spark, folder, kind=_kind):
        return ranking.top(_events(spark, folder), "value", 3, kind == "top_min").select("user_id", "place", "value")

    def _top_pos(spark, folder, kind=_kind):
        return ranking.top(_events(spark, folder), "value", 3, kind == "top_min").select("user_id", "place", "pos")

    _ranked = f"{E}, t as (select *, row_number() over (partition by user_id order by value {_dir}, pos) as place from e)"
    query(_kind, f"{_ranked} select user_id, place, value from t where place <= 3")(_top)
    query(f"{_kind}_pos", f"{_ranked} select user_id, place, pos from t where place <= 3")(_top_pos)


@query("distinct_values", "select count(distinct o_totalprice) as n from orders")
def _(spark, folder):
    return _table(spark, folder, "orders").select("o_totalprice").distinct().agg(F.count("o_totalprice").alias("n"))


def _single(spark, folder, *columns: str) -> DataFrame:
    """All events as one series in order of time."""
    return _table(spark, folder, "events").select("event_id", "ts", *(columns or ("value",)))


@query(
    "longest_gaps",
    """select event_id, gap_us from (select event_id, epoch_us(ts) - lag(epoch_us(ts)) over (order by ts) as gap_us from events) where gap_us is not null order by gap_us desc, event_id limit 5""",
)
def _(spark, folder):
    df = _table(spark, folder, "events")
    gaps = single.changes(df.select("event_id", "ts", micros(df, "ts").alias("us")), ["ts"], "us", "gap_us")
    return gaps.select("event_id", "gap_us").orderBy(F.col("gap_us").desc(), "event_id").limit(5)


@query("single_positions", "select event_id, row_number() over (order by ts) - 1 as pos from events")
def _(spark, folder):
    return single.positions(_table(spark, folder, "events").select("event_id", "ts"), ["ts"]).select("event_id", "pos")


@query("single_running_sum", "select event_id, round(sum(value) over (order by ts), 2) as result from events")
def _(spark, folder):
    return single.running(_table(spark, folder, "events").select("event_id", "ts", "value"), ["ts"], "value").select("event_id", F.round("running", 2).alias("result"))


@query(
    "single_ema",
    """with recursive e as (select event_id, value, row_number() over (order by ts) - 1 as pos from events),
    m as (select event_id, pos, value::double as ema from e where pos = 0 union all select e.event_id, e.pos, e.value * 2.0 / 11 + m.ema * (1 - 2.0 / 11) from m join e on e.pos = m.pos + 1)
    select event_id, round(ema, 6) as result from m""",
)
def _(spark, folder):
    return single.moving_average(_table(spark, folder, "events").select("event_id", "ts", "value"), ["ts"], "value", 10).select("event_id", r6("ema").alias("result"))


@query("single_changes", "select event_id, round(coalesce(value - lag(value) over (order by ts), 0), 6) as result from events")
def _(spark, folder):
    return single.changes(_single(spark, folder), ["ts"], "value").select("event_id", r6("change").alias("result"))


_ONE = "with e as (select *, row_number() over (order by ts) - 1 as pos from events)"


@query("single_runs", f"{_ONE} select event_id, sum(new) over (order by pos rows unbounded preceding)::bigint - 1 as run_id from (select *, case when event_type is not distinct from lag(event_type) over (order by pos) and pos > 0 then 0 else 1 end as new from e)")
def _(spark, folder):
    return single.runs(_single(spark, folder, "event_type"), ["ts"], "event_type").select("event_id", "run_id")


@query("single_unique", f"{_ONE} select event_id from (select *, lag(event_type) over (order by pos) as p from e) where pos = 0 or event_type is distinct from p")
def _(spark, folder):
    return single.unique(_single(spark, folder, "event_type"), ["ts"], "event_type").select("event_id")


@query(
    "single_trend",
    f"""{_ONE}, s as (select event_id, pos, nullif(sign(floor(value / 20) - lag(floor(value / 20)) over (order by pos)), 0)::int as s from e)
    select event_id, coalesce(last_value(s ignore nulls) over (order by pos rows unbounded preceding), 0) as trend from s""",
)
def _(spark, folder):
    return single.trend(_single(spark, folder).withColumn("value", F.floor(F.col("value") / 20)), ["ts"], "value").select("event_id", "trend")


for _kind, _f in (("max", "max(value)"), ("min", "min(value)"), ("avg", "avg(value)"), ("var", "var_pop(value)"), ("dev", "stddev_pop(value)"), ("prd", "product(1 + (value - 50) / 100000)")):

    def _single_cum(spark, folder, kind=_kind):
        rows = _single(spark, folder)
        if kind == "prd":
            rows = rows.withColumn("value", 1 + (F.col("value") - 50) / 100000)
        return single.running(rows, ["ts"], "value", kind).select("event_id", F.round(F.col("running") + HALF, 4).alias("result"))

    query(f"single_cum_{_kind}", f"select event_id, round({_f} over (order by ts rows unbounded preceding) + 1e-7, 4) as result from events")(_single_cum)


@query(
    "single_atr",
    """with recursive e as (select event_id, value, row_number() over (order by ts) - 1 as pos from events),
    m as (select event_id, pos, value::double as a from e where pos = 0 union all select e.event_id, e.pos, (m.a * (least(e.pos + 1, 14) - 1) + e.value) / least(e.pos + 1, 14) from m join e on e.pos = m.pos + 1)
    select event_id, round(a, 6) as result from m""",
)
def _(spark, folder):
    return single.smoothed_range(_single(spark, folder), ["ts"], "value", 14).select("event_id", r6("atr").alias("result"))


@query("single_sort", f"{_ONE} select event_id, row_number() over (order by floor(value), pos) - 1 as pos, pos as from_pos from e")
def _(spark, folder):
    rows = single.positions(_single(spark, folder).withColumn("value", F.floor("value")), ["ts"])
    return single.sort(rows, "value", "pos").select("event_id", "pos", "from_pos")


for _name, _dense in (("single_rank", False), ("single_dense_rank", True)):
    query(_name, f"select event_id, {'dense_rank' if _dense else 'rank'}() over (order by floor(value) desc) as result from events")(
        lambda spark, folder, dense=_dense: single.ranks(_single(spark, folder).withColumn("value", F.floor("value")), "value", "result", descending=True, dense=dense).select("event_id", "result")
    )


@query("single_quantiles", "with k as (select value as v, row_number() over (order by value) - 1 as k, count(*) over () as n from events), p as (select *, unnest([0, 1, 2, 3, 4, 5]) as part from k) select part, v from p where (part < 5 and k = n * part // 5) or (part = 5 and k = n - 1)")
def _(spark, folder):
    return single.quantiles(_single(spark, folder), "value", 5)


@query("spread_runs", f"{_RUNS} select user_id, event_id, run_id::bigint as run_id from r")
def _(spark, folder):
    return single.runs(_table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type"), ["ts"], "event_type", ids=["user_id"]).select("user_id", "event_id", "run_id")


@query("spread_quantiles", "with k as (select user_id, value as v, row_number() over (partition by user_id order by value) - 1 as k, count(*) over (partition by user_id) as n from events), p as (select *, unnest([0, 1, 2, 3, 4, 5]) as part from k) select user_id, part, v from p where (part < 5 and k = n * part // 5) or (part = 5 and k = n - 1)")
def _(spark, folder):
    return single.quantiles(_table(spark, folder, "events").select("user_id", "value"), "value", 5, ["user_id"])


@query("spread_positions", f"{E} select user_id, event_id, pos from e")
def _(spark, folder):
    s = Series.of(_table(spark, folder, "events").select("user_id", "ts", "event_id"), ["ts"], ["user_id"], spread=True)
    return s.df.select("user_id", "event_id", "pos")


@query("spread_running_sum", "select user_id, event_id, round(sum(value) over (partition by user_id order by ts), 2) as result from events")
def _(spark, folder):
    rows = _table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    return single.running(rows, ["ts"], "value", ids=["user_id"]).select("user_id", "event_id", F.round("running", 2).alias("result"))


@query("spread_window_avg", f"{E} select user_id, event_id, round({_WINDOW['avg']}, 4) as result from e")
def _(spark, folder):
    p = single.pieces(_table(spark, folder, "events").select("user_id", "ts", "event_id", "value"), ["ts"], _N - 1, ["user_id"])
    return p.df.select("user_id", "event_id", "halo", F.round(windows.window(p, "avg", "value", _N), 4).alias("result")).where("not halo").drop("halo")


# re-shaping


@query("filter", f"{E} select user_id, row_number() over (partition by user_id order by pos) - 1 as pos, value from e where value > 50")
def _(spark, folder):
    return reshape.filter_elements(_events(spark, folder), F.col("value") > 50).keep("value")


@query("filter_pos", f"{E} select user_id, pos from e where value > 50")
def _(spark, folder):
    return reshape.filter_pos(_events(spark, folder), F.col("value") > 50)


@query("filter_first_pos", f"{E} select user_id, pos from (select *, row_number() over (partition by user_id order by pos) as k from e where value > 50) where k <= 4")
def _(spark, folder):
    return reshape.filter_first_pos(_events(spark, folder), F.col("value") > 50, 4)


@query("iif", f"{E} select user_id, pos, case when value > 50 then value else -event_id end as result from e")
def _(spark, folder):
    s = _events(spark, folder, "value", "event_id")
    return s.df.select("user_id", "pos", reshape.iif(F.col("value") > 50, F.col("value"), -F.col("event_id")).alias("result"))


@query(
    "if_consuming",
    f"""{E}, k as (select user_id, pos, value > 50 as t, sum(case when value > 50 then 1 else 0 end) over w as a, sum(case when value > 50 then 0 else 1 end) over w as b from e window w as (partition by user_id order by pos rows unbounded preceding))
    select k.user_id, k.pos, case when k.t then e.event_id else -e.event_id end as result from k join e on e.user_id = k.user_id and e.pos = case when k.t then a else b end - 1""",
)
def _(spark, folder):
    s = _events(spark, folder, "value", "event_id").with_column("minus", -F.col("event_id"))
    return reshape.choose(s, F.col("value") > 50, (s, "event_id"), (s, "minus"), "result")


_SIZED = f"{E}, n as (select *, count(*) over (partition by user_id) as n from e)"
for _name, _f, _sql in (
    ("limit", lambda s: reshape.limit(s, 2, -3), "pos - 2 as pos, value from n where pos >= 2 and pos <= n - 3"),
    ("head", lambda s: reshape.head(s, 3), "pos, value from n where pos between 0 and 2"),
    ("tail", lambda s: reshape.tail(s, 3), "pos - greatest(n - 3, 0) as pos, value from n where pos >= n - 3"),
    ("cut_head", lambda s: reshape.cut_head(s, 3), "pos - 3 as pos, value from n where pos >= 3"),
    ("cut_tail", lambda s: reshape.cut_tail(s, 3), "pos, value from n where pos < n - 3"),
    ("thin", lambda s: reshape.thin(s, 1, 4), "(pos - 1) // 4 as pos, value from n where pos >= 1 and (pos - 1) % 4 = 0"),
    ("reverse", lambda s: reshape.reverse(s), "n - 1 - pos as pos, value from n"),
    ("repeat", lambda s: reshape.repeat(s, 3), "pos * 3 + k as pos, value from (select *, unnest([0, 1, 2]) as k from n)"),
):
    query(_name, f"{_SIZED} select user_id, {_sql}")(lambda spark, folder, f=_f: f(_events(spark, folder)).keep("value"))


@query("unique", f"{E} select user_id, row_number() over (partition by user_id order by pos) - 1 as pos, event_type from (select *, lag(event_type) over w as p from e {W}) where pos = 0 or event_type is distinct from p")
def _(spark, folder):
    return reshape.unique(_events(spark, folder, "event_type"), "event_type").keep("event_type")


@query("diff", f"{E} select user_id, pos, round(coalesce(value - lag(value) over w, 0), 6) as result from e {W}")
def _(spark, folder):
    s = _events(spark, folder)
    return s.df.select("user_id", "pos", r6(reshape.diff(s, "value")).alias("result"))


_TREND = f"""{E}, s as (select *, nullif(sign(value - lag(value) over w), 0)::int as s from (select user_id, pos, floor(value / 20) as value from e) {W}),
t as (select user_id, pos, coalesce(last_value(s ignore nulls) over (partition by user_id order by pos rows unbounded preceding), 0) as t from s)"""


def _steps(spark, folder) -> Series:
    return _events(spark, folder).with_column("value", F.floor(F.col("value") / 20))


@query("trend", f"{_TREND} select user_id, pos, t::int as trend from t")
def _(spark, folder):
    return reshape.with_trend(_steps(spark, folder), "value").keep("trend")


@query("norm", f"{E} select user_id, pos, round(value / sqrt(sum(value * value) over (partition by user_id)), 6) as result from e")
def _(spark, folder):
    s = _events(spark, folder)
    return s.df.select("user_id", "pos", r6(reshape.norm(s, "value")).alias("result"))


@query("is_empty", "select (select count(*) from events where value > 1e9) = 0 as none, (select count(*) from events) = 0 as some")
def _(spark, folder):
    s = _events(spark, folder)
    return spark.createDataFrame([(reshape.is_empty(s.where("value > 1e9")), reshape.is_empty(s))], "none boolean, some boolean")


def _typed(spark, folder, kind: str) -> Series:
    return Series.of(_table(spark, folder, "events").where(F.col("event_type") == kind).select("user_id", "ts", "value", "event_id"), ["ts"], ["user_id"])


_SIDES = """with a as (select *, row_number() over (partition by user_id order by ts) - 1 as pos from events where event_type = 'view'),
b as (select *, row_number() over (partition by user_id order by ts) - 1 as pos from events where event_type = 'click')"""


@query("concat", f"{_SIDES} select user_id, row_number() over (partition by user_id order by side, pos) - 1 as pos, event_id from (select user_id, pos, event_id, 0 as side from a union all select user_id, pos, event_id, 1 from b)")
def _(spark, folder):
    return reshape.concat(_typed(spark, folder, "view"), _typed(spark, folder, "click")).keep("event_id")


for _name, _copies in (("union", "greatest"), ("intersect", "least")):

    def _multi(spark, folder, name=_name):
        tens = lambda k: _typed(spark, folder, k).df.select("user_id", F.floor(F.col("value") / 10).cast("long").alias("v"))
        f = reshape.union if name == "union" else reshape.intersect
        return f(tens("view"), tens("click"), ["user_id", "v"])

    query(
        _name,
        f"""{_SIDES}, c as (select user_id, floor(value / 10)::bigint as v, count(*) filter (side = 0) as l, count(*) filter (side = 1) as r from (select user_id, value, 0 as side from a union all select user_id, value, 1 from b) group by 1, 2)
        select user_id, v from (select user_id, v, unnest(generate_series(1, {_copies}(l, r))) as k from c where {_copies}(l, r) > 0)""",
    )(_multi)

# joins by time


def _minutes(spark, folder, kind: str, name: str) -> DataFrame:
    """Events of a kind with their time in 10-hour steps, so that times meet."""
    s = _typed(spark, folder, kind)
    return s.df.select("user_id", F.floor(micros(s.df, "ts") / 36_000_000_000).cast("long").alias("t"), F.col("event_id").alias(name), "pos")


_STEPS = """with a as (select user_id, epoch_us(ts) // 36000000000 as t, event_id as l, row_number() over (partition by user_id order by ts) - 1 as pos from events where event_type = 'view'),
b as (select user_id, epoch_us(ts) // 36000000000 as t, event_id as v, row_number() over (partition by user_id order by ts) - 1 as pos from events where event_type = 'click')"""


@query(
    "ts_join",
    f"""{_STEPS}, x as (select *, row_number() over (partition by user_id, t order by pos) as k from a), y as (select *, row_number() over (partition by user_id, t order by pos) as k from b)
    select user_id, t, v, x.pos as left_pos, y.pos as right_pos from x join y using (user_id, t, k)""",
)
def _(spark, folder):
    return tsjoin.equi(_minutes(spark, folder, "view", "l"), _minutes(spark, folder, "click", "v"), ["user_id"], "t", "v")


def _exact(spark, folder, kind: str, name: str) -> DataFrame:
    s = _typed(spark, folder, kind)
    return s.df.select("user_id", micros(s.df, "ts").alias("t"), F.col("event_id").alias(name), "pos")


_TIMES = """with a as (select user_id, epoch_us(ts) as t, event_id as l from events where event_type = 'view'),
b as (select user_id, epoch_us(ts) as t, event_id as v, row_number() over (partition by user_id order by ts) - 1 as pos from events where event_type = 'click'),
p as (select a.user_id, a.t, a.l, b.t as pt, b.v as pv, b.pos as pp from a asof left join b on a.user_id = b.user_id and a.t >= b.t),
n as (select p.*, b.t as nt, b.v as nv, b.pos as np from p asof left join b on p.user_id = b.user_id and p.t <= b.t)"""


@query("asof_join", f"{_TIMES} select user_id, t, l, case when pt is null then nv when nt is null then pv when t - pt <= nt - t then pv else nv end as v from n")
def _(spark, folder):
    found = tsjoin.neighbours(_exact(spark, folder, "view", "l").drop("pos"), _exact(spark, folder, "click", "v"), ["user_id"], "t", ["v"])
    return tsjoin.nearest(found, "t", "v", "v")


@query("asof_join_chunked", f"{_TIMES} select user_id, t, l, case when pt is null then nv when nt is null then pv when t - pt <= nt - t then pv else nv end as v from n")
def _(spark, folder):
    found = tsjoin.neighbours(_exact(spark, folder, "view", "l").drop("pos"), _exact(spark, folder, "click", "v"), ["user_id"], "t", ["v"], chunk=86_400_000_000)
    return tsjoin.nearest(found, "t", "v", "v")


@query("asof_join_pos", f"{_TIMES} select user_id, l, case when pt is null then np when nt is null then pp when t - pt <= nt - t then pp else np end as right_pos from n")
def _(spark, folder):
    found = tsjoin.neighbours(_exact(spark, folder, "view", "l").drop("pos"), _exact(spark, folder, "click", "v"), ["user_id"], "t", ["pos"])
    return tsjoin.nearest(found, "t", "pos", "right_pos").select("user_id", "l", "right_pos")


for _name, _dir, _sql in (("join_forward", 1, "np"), ("join_backward", -1, "pp"), ("join_exact", 0, "case when nt = t then np end")):
    query(_name, f"{_TIMES} select user_id, l, {_sql} as right_pos from n")(
        lambda spark, folder, d=_dir: tsjoin.point(_exact(spark, folder, "view", "l").drop("pos"), _exact(spark, folder, "click", "v"), ["user_id"], "t", d, "null").select("user_id", "l", "right_pos")
    )


@query("stretch", f"{_TIMES}, s as (select a.*, b.v from a asof left join b on a.user_id = b.user_id and a.t < b.t) select user_id, t, l, coalesce(v, -1) as v from s")
def _(spark, folder):
    return tsjoin.stretch(_exact(spark, folder, "view", "l").drop("pos"), _exact(spark, folder, "click", "v"), ["user_id"], "t", "v", F.lit(-1))


@query("stretch0", f"{_STEPS}, x as (select distinct user_id, t from a), y as (select user_id, t, max(v) as v from b group by user_id, t) select user_id, t, case when y.v is not null then y.v else 0 end as v from x full join y using (user_id, t)")
def _(spark, folder):
    right = _minutes(spark, folder, "click", "v").groupBy("user_id", "t").agg(F.max("v").alias("v"))
    return tsjoin.stretch0(_minutes(spark, folder, "view", "l"), right, ["user_id"], "t", "v", F.lit(0))


@query("map", f"{E}, t as (select user_id, pos, row_number() over (partition by user_id order by value desc, pos) as k from e) select user_id, k, t.pos, event_id from t join e using (user_id, pos) where k <= 3")
def _(spark, folder):
    s = _events(spark, folder, "value", "event_id")
    best = ranking.top(s, "value", 3).select("user_id", "pos", F.col("place").alias("k"))
    return tsjoin.gather(s.df, best, ["user_id"], "pos", "event_id").select("user_id", "k", "pos", "event_id")


# histograms, crossings, extrema


@query(
    "histogram",
    """with u as (select distinct user_id, unnest(generate_series(0, 9)) as bin from events), c as (select user_id, floor(value * 10 / 100)::int as bin, count(*) as n from events where value >= 0 and value < 100 group by 1, 2)
    select user_id, u.bin::int as bin, coalesce(n, 0) as n from u left join c using (user_id, bin)""",
)
def _(spark, folder):
    return special.histogram(_table(spark, folder, "events"), ["user_id"], "value", 0, 100, 10)


@query(
    "cross",
    f"""{E}, s as (select user_id, pos, sign(floor((value - 50) / 30))::int as s from e), z as (select * from s where s <> 0), b as (select *, lag(s) over w as p, lag(pos) over w as pp from z {W})
    select user_id, pp + 1 as pos from b where p is not null and p <> s""",
)
def _(spark, folder):
    s = _events(spark, folder).with_column("v", F.floor((F.col("value") - 50) / 30))
    return special.cross(s, "v")


for _name, _kind in (("extrema", 0), ("maxima", 1), ("minima", -1)):
    _keep = "" if not _kind else f" and p = {_kind}"
    query(_name, f"{_TREND}, x as (select *, lag(t) over w as p from t {W}) select user_id, pos - 1 as pos from x where t * p = -1{_keep}")(
        lambda spark, folder, k=_kind: special.extrema(_steps(spark, folder), "value", k)
    )

# elements


@query(
    "arithmetic",
    f"""{E} select user_id, pos, value + event_id as plus, round(value - event_id, 6) as minus, round(value * 2.5, 6) as times, case when pos % 3 = 0 then case when value > 0 then 'Infinity'::double else 'NaN'::double end else round(value / (pos % 3), 6) end as quotient,
    case when pos % 3 = 0 then 'NaN'::double else round(fmod(value, pos % 3), 6) end as remainder, round(power(value, 2), 4) as square, event_id // 7 as whole, event_id % 7 as left_over, -value as negative, abs(value - 50) as distance from e""".replace("abs(value - 50)", "round(abs(value - 50), 6)"),
)
def _(spark, folder):
    s = _events(spark, folder, "value", "event_id")
    v, k, d = F.col("value"), F.col("event_id"), F.col("pos") % 3
    q = S.div(v, d)
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(r6(c))
    return s.df.select(
        "user_id", "pos", (v + k).alias("plus"), r6(v - k).alias("minus"), r6(v * 2.5).alias("times"), finite(q).alias("quotient"), finite(S.mod(v, d)).alias("remainder"),
        F.round(S.power(v, F.lit(2)), 4).alias("square"), S.int_div(k, F.lit(7)).alias("whole"), S.int_mod(k, F.lit(7)).alias("left_over"), (-v).alias("negative"), r6(F.abs(v - 50)).alias("distance"),
    )


@query("bitwise", "select event_id, event_id & 12 as a, event_id | 5 as o, xor(event_id, 9) as x, ~event_id as n, not (event_id % 2 = 0) as odd from events")
def _(spark, folder):
    k = F.col("event_id")
    return _table(spark, folder, "events").select("event_id", k.bitwiseAND(12).alias("a"), k.bitwiseOR(5).alias("o"), k.bitwiseXOR(9).alias("x"), F.bitwise_not(k).alias("n"), (~(k % 2 == 0)).alias("odd"))


_PAIRS = ("eq", "=", S.eq), ("ne", "<>", S.ne), ("lt", "<", S.lt), ("le", "<=", S.le), ("gt", ">", S.gt), ("ge", ">=", S.ge)
for _name, _kind, _a, _b, _sql_a, _sql_b in (
    ("compare_strings", "strings", lambda: F.col("event_type"), lambda: F.lit("purchase"), "event_type", "'purchase'"),
    ("compare_dates", "dates", lambda: F.to_date("ts"), lambda: F.lit("2024-01-15").cast("date"), "ts::date", "date '2024-01-15'"),
    ("compare_times", "times", lambda: F.col("ts"), lambda: F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), "ts", "timestamp '2024-01-15 12:00:00'"),
):

    def _compare(spark, folder, a=_a, b=_b):
        return _table(spark, folder, "events").select("event_id", *[f(a(), b()).alias(n) for n, _, f in _PAIRS], S.maxof(a(), b()).cast("string").alias("hi"), S.minof(a(), b()).cast("string").alias("lo"))

    _text = (lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')") if _kind == "times" else (lambda c: f"({c})::varchar")
    query(_name, "select event_id, " + ", ".join(f"{_sql_a} {o} {_sql_b} as {n}" for n, o, _ in _PAIRS) + f", {_text(f'greatest({_sql_a}, {_sql_b})')} as hi, {_text(f'least({_sql_a}, {_sql_b})')} as lo from events")(
        _compare if _kind != "times" else lambda spark, folder, f=_compare: f(spark, folder).withColumn("hi", F.substring("hi", 1, 19)).withColumn("lo", F.substring("lo", 1, 19))
    )


@query(
    "compare_nan",
    "select event_id, event_id % 3 = 0 as nan, event_id % 3 <> 0 and value = 50 as eq, event_id % 3 = 0 or value <> 50 as ne, event_id % 3 <> 0 and value < 50 as lt, event_id % 3 <> 0 and value <= 50 as le, event_id % 3 <> 0 and value > 50 as gt, event_id % 3 <> 0 and value >= 50 as ge from events",
)
def _(spark, folder):
    v, h = F.when(F.col("event_id") % 3 == 0, S.nan()).otherwise(F.col("value")), F.lit(50.0)
    return _table(spark, folder, "events").select("event_id", F.isnan(v).alias("nan"), *[f(v, h).alias(n) for n, _, f in _PAIRS])


@query("join_strings", "select event_id, event_type || '/' || user_id::varchar as joined from events")
def _(spark, folder):
    return _table(spark, folder, "events").select("event_id", S.join_strings(S.join_strings(F.col("event_type"), F.lit("/")), F.col("user_id").cast("string")).alias("joined"))


@query("key_as", "select l_returnflag as flag, ascii(l_linestatus) as status, count(*) as n from lineitem group by all")
def _(spark, folder):
    key = S.as_type(S.cat(a=F.col("l_returnflag"), b=F.ascii("l_linestatus")), "struct<flag: string, status: bigint>")
    return agg.by_key(_table(spark, folder, "lineitem").withColumn("key", key), ["key"], n=F.count("*")).select("key.flag", F.col("key.status").cast("int").alias("status"), "n")


@query("element_types", "select * from (values ('event_id', 'int8', 8), ('ts', 'timestamp', 8), ('event_type', 'bpchar', null), ('value', 'float8', 8)) as t(name, kind, size)")
def _(spark, folder):
    df = _table(spark, folder, "events")
    return spark.createDataFrame([(c, ty.type_of(df, c), ty.elem_size(df, c)) for c in ("event_id", "ts", "event_type", "value")], "name string, kind string, size int")


@query(
    "compare",
    "select event_id, value = 50 as eq, value <> 50 as ne, value < 50 as lt, value <= 50 as le, value > 50 as gt, value >= 50 as ge, greatest(value, event_id) as hi, least(value, event_id) as lo, false as nan from events",
)
def _(spark, folder):
    v, h, k = F.col("value"), F.lit(50.0), F.col("event_id").cast("double")
    return _table(spark, folder, "events").select(
        "event_id", S.eq(v, h).alias("eq"), S.ne(v, h).alias("ne"), S.lt(v, h).alias("lt"), S.le(v, h).alias("le"), S.gt(v, h).alias("gt"), S.ge(v, h).alias("ge"), S.maxof(v, k).alias("hi"), S.minof(v, k).alias("lo"), F.isnan(v).alias("nan")
    )


_MATH_SQL = {
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "exp": "exp(x)", "asin": "asin(x / 3)", "acos": "acos(x / 3)", "atan": "atan(x)", "sqrt": "sqrt(x)", "log": "case when x = 0 then '-Infinity'::double else round(ln(x), 6) end",
    "ceil": "ceil(x)", "floor": "floor(x)",
}


@query("math", "select event_id, " + ", ".join(f"{c if n == 'log' else f'round({c}, 6)'} as {n}_x" for n, c in _MATH_SQL.items()) + " from (select event_id, (event_id % 30) / 10.0::double as x from events)")
def _(spark, folder):
    rows = _table(spark, folder, "events").select("event_id", ((F.col("event_id") % 30) / 10.0).alias("x"))
    x = F.col("x")
    cols = []
    for n in _MATH_SQL:
        c = S.math(n, x / 3 if n in ("asin", "acos") else x)
        cols.append((F.when(x == 0, c).otherwise(r6(c)) if n == "log" else r6(c)).alias(f"{n}_x"))
    return rows.select("event_id", *cols)


@query(
    "calendar",
    """select event_id, year(ts) as y, month(ts) as m, day(ts) as mday, dayofweek(ts) as wday, (date_diff('day', date '2000-01-01', ts::date) - dayofweek(ts)) // 7 as week, quarter(ts) as q, hour(ts) as h, minute(ts) as mi, second(ts) as s,
    date_diff('day', date '2000-01-01', ts::date) // 3 as third from events""",
)
def _(spark, folder):
    t = F.col("ts")
    names = {"year": "y", "month": "m", "mday": "mday", "wday": "wday", "week": "week", "quarter": "q"}
    return _table(spark, folder, "events").select(
        "event_id", *[S.CALENDAR[k](t).cast("long").alias(n) for k, n in names.items()], *[S.CLOCK[k](t).cast("long").alias(n) for k, n in (("hour", "h"), ("minute", "mi"), ("second", "s"))], S.int_div(S.days2000(t), F.lit(3)).alias("third")
    )


@query("casts", "select event_id, value::int as v, ts::date as d, epoch_us(ts) % 86400000000 as us, substr(event_id::varchar, 1, 3) as s, round(value::decimal(19, 2)::double, 2) as money from (select event_id, trunc(value) as value, ts from events)")
def _(spark, folder):
    v = F.floor("value").cast("double")
    return _table(spark, folder, "events").select(
        "event_id", ty.cast(v, "float8", "int4").alias("v"), ty.cast(F.col("ts"), "timestamp", "date").alias("d"), ty.cast(F.col("ts"), "timestamp", "time").alias("us"),
        ty.cast(F.col("event_id"), "int8", "bpchar", 3).alias("s"), ty.cast(v, "float8", "money").cast("double").alias("money"),
    )


@query("like", "select p_partkey, p_name like '%re_%' as l, p_name ilike '%RE_%' as i, p_type like '%\\_%' escape '\\' as under from part")
def _(spark, folder):
    return _table(spark, folder, "part").select("p_partkey", S.like(F.col("p_name"), "%re?%").alias("l"), S.ilike(F.col("p_name"), "%RE?%").alias("i"), S.like(F.col("p_type"), "%_%").alias("under"))


_WORDS = "with d as (select word, row_number() over (order by word) - 1 as code from (select distinct word from (select unnest([event_type, props]) as word from events) where word is not null))"


@query("dictionary", f"{_WORDS} select event_id, d.code as type_code, d.word as type_word from events join d on d.word = event_type")
def _(spark, folder):
    df = _table(spark, folder, "events")
    words = dictionary.dictionary(df, ["event_type", "props"])
    coded = dictionary.encode(df.select("event_id", "event_type"), words, "event_type", "type_code")
    return dictionary.decode(coded, words, "type_code", "type_word").select("event_id", "type_code", "type_word")


@query("dictionary_key", f"{_WORDS} select d.word as type_word, e.user_id % 7 as u, count(*) as n from events e join d on d.word = e.event_type group by all")
def _(spark, folder):
    df = _table(spark, folder, "events")
    words = dictionary.dictionary(df, ["event_type", "props"])
    keyed = dictionary.encode(df.select("user_id", "event_type"), words, "event_type", "code").select(S.cat(code=F.col("code"), u=F.col("user_id") % 7).alias("key"))
    return dictionary.decode_key(agg.by_key(keyed, ["key"], n=F.count("*")), words, "key", "code", "type_word").select("type_word", "key.u", "n")


@query("dictionary_size", f"{_WORDS} select count(*) as n from d")
def _(spark, folder):
    return dictionary.size(dictionary.dictionary(_table(spark, folder, "events"), ["event_type", "props"]))


@query("arrays", f"{E} select user_id, pos, event_id from e")
def _(spark, folder):
    s = _events(spark, folder, "event_id")
    return ty.from_array(ty.to_array(s.df, ["user_id"], "pos", "event_id"), "items", "pos", "event_id")


@query("text_output", f"{_SIZED} select user_id, '{{' || string_agg(event_id, ',' order by pos) filter (pos < 5) || case when max(n) > 5 then ',...' else '' end || '}}' as text from n group by user_id")
def _(spark, folder):
    return ty.to_text(_events(spark, folder, "event_id").df, ["user_id"], "pos", "event_id", 5)


@query("literals", "select unnest([0, 1, 2, 3]) as pos, unnest([3.14, 16.0, 10.0, -5.0]::double[]) as v")
def _(spark, folder):
    whole = ty.sequence(spark, "int4:{0, 0x10, 012, -5}")
    return whole.select("pos", F.when(F.col("pos") == 0, ty.const(3.14, "float8")).otherwise(F.col("v").cast("double")).alias("v"))


@query("call_builtin", "select event_id, round(sin(value), 6) as result from events")
def _(spark, folder):
    return _table(spark, folder, "events").select("event_id", r6(udf.call(F.col("value"), "sin")).alias("result"))


@query("call_function", "select event_id, value * 2 as result from events")
def _(spark, folder):
    def twice(x):
        return x * 2.0

    return _table(spark, folder, "events").select("event_id", udf.call(F.col("value"), twice).alias("result"))


udf.watch(agg, dictionary, ranking, reshape, runs, special, tsjoin, windows)


@query("profile", "select * from (values ('agg.one', 2), ('reshape.limit', 1), ('reshape.tail', 1), ('sqrt', 1), ('TOTAL', 5)) as t(command, counter)")
def _(spark, folder):
    udf.profile(spark, reset=True)
    s = Series(_table(spark, folder, "events").withColumn("pos", F.col("event_id")), ("user_id",))
    reshape.tail(s, 3)
    agg.one("sum", "value")
    agg.one("max", "value")
    udf.call(F.col("value"), "sqrt")
    return udf.profile(spark)


# the store


def _store(spark, folder) -> Store:
    return Store.load(_table(spark, folder, "events").select("user_id", "ts", "value", "event_id"), "ts", ["user_id"])


_FROM, _TILL = "2024-01-10 00:00:00", "2024-01-20 00:00:00"
_BETWEEN = f"ts between timestamp '{_FROM}' and timestamp '{_TILL}'"


def _ntz(text: str):
    import datetime

    return datetime.datetime.fromisoformat(text)


@query("store_get", f"select user_id, row_number() over (partition by user_id order by ts) - 1 as pos, event_id from events where {_BETWEEN}")
def _(spark, folder):
    return _store(spark, folder).get(None, _ntz(_FROM), _ntz(_TILL)).series.keep("event_id")


@query("store_get_ids", f"select user_id, row_number() over (partition by user_id order by ts) - 1 as pos, event_id from events where {_BETWEEN} and user_id in (3, 5, 8)")
def _(spark, folder):
    return _store(spark, folder).get([3, 5, 8], _ntz(_FROM), _ntz(_TILL)).series.keep("event_id")


@query("store_limit", f"{E}, k as (select *, row_number() over (partition by user_id order by pos desc) as k from e where ts <= timestamp '{_TILL}') select user_id, row_number() over (partition by user_id order by pos) - 1 as pos, event_id from k where k <= 4")
def _(spark, folder):
    return _store(spark, folder).get(None, None, _ntz(_TILL), 4).series.keep("event_id")


@query("store_span", f"{_SIZED} select user_id, pos - 1 as pos, event_id from n where pos >= 1 and pos <= n - 2")
def _(spark, folder):
    return _store(spark, folder).span(None, 1, -2).series.keep("event_id")


@query("store_concat", f"{E} select row_number() over (order by case user_id when 8 then 0 when 3 then 1 else 2 end, pos) - 1 as pos, event_id from e where user_id in (8, 3, 5)")
def _(spark, folder):
    return _store(spark, folder).concat([8, 3, 5, -1]).keep("event_id")


@query("store_ends", "select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from events group by user_id")
def _(spark, folder):
    s = _store(spark, folder)
    return s.first().join(s.last(), "user_id").join(s.count(), "user_id")


@query("store_ends_ids", "select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from events where user_id in (3, 5, 8) group by user_id")
def _(spark, folder):
    s = _store(spark, folder)
    return s.first([3, 5, 8]).join(s.last([3, 5, 8]), "user_id").join(s.count([3, 5, 8]), "user_id")


@query("store_span_ids", f"{_SIZED} select user_id, pos - 1 as pos, event_id from n where pos >= 1 and pos <= n - 2 and user_id in (3, 5)")
def _(spark, folder):
    return _store(spark, folder).span([3, 5], 1, -2).series.keep("event_id")


@query("store_loaded", "select true as loaded, true as held, false as after")
def _(spark, folder):
    from ..sources.store import used_memory

    s = _store(spark, folder).cache()
    s.rows.count()
    loaded, held = s.is_loaded(), used_memory(spark) > 0
    s.drop()
    return spark.createDataFrame([(loaded, held, s.is_loaded())], "loaded boolean, held boolean, after boolean")


@query("store_truncate", "select user_id, 0::bigint as pos, event_id from events where false")
def _(spark, folder):
    return _store(spark, folder).truncate().series.keep("event_id")


@query("store_delete", f"select user_id, row_number() over (partition by user_id order by ts) - 1 as pos, event_id from events where not ({_BETWEEN})")
def _(spark, folder):
    return _store(spark, folder).delete(None, _ntz(_FROM), _ntz(_TILL)).series.keep("event_id")


@query("store_append", f"{E} select user_id, pos, event_id from e")
def _(spark, folder):
    df = _table(spark, folder, "events").select("user_id", "ts", "value", "event_id")
    old = Store.load(df, "ts", ["user_id"], where=f"ts < timestamp_ntz '{_FROM}'")
    return old.append(df, _ntz(_FROM)).series.keep("event_id")


@query("store_columns", f"{E} select user_id, pos, event_type from e")
def _(spark, folder):
    s = _store(spark, folder).truncate_column("value")
    return s.load_column(_table(spark, folder, "events"), "event_type", ["event_id"]).series.keep("event_type")


@query("store_project", f"{E}, k as (select *, row_number() over (partition by user_id order by value desc, pos) as k from e) select user_id, ts, value, event_id, pos from k where k <= 2")
def _(spark, folder):
    s = _store(spark, folder)
    return s.project(ranking.top(s.series, "value", 2).select("user_id", "pos")).select("user_id", "ts", "value", "event_id", "pos")


@query("store_save", f"{E} select user_id, pos, event_id from e where user_id = 8")
def _(spark, folder):
    path = new_folder(spark, "store")
    _store(spark, folder).save(path)
    return Store.read(spark, path, "ts", ["user_id"]).get(8).series.keep("event_id")


@query("store_save_all", f"{E} select user_id, pos, event_id from e")
def _(spark, folder):
    path = new_folder(spark, "store")
    _store(spark, folder).save(path)
    return Store.read(spark, path, "ts", ["user_id"]).series.keep("event_id")


@query("csv_round_trip", "select l_orderkey, l_linenumber, l_extendedprice from lineitem")
def _(spark, folder):
    from ..sources.store import read_csv

    path = new_folder(spark, "csv")
    rows = _table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    rows.write.option("sep", "|").csv(path)
    return read_csv(spark, path, "l_orderkey long, l_linenumber int, l_extendedprice double", sep="|")


# streams


@query(
    "stream_state",
    f"""with recursive e as (select user_id, ts, value, row_number() over (partition by user_id order by ts) - 1 as pos from events),
    m as (select user_id, pos, ts, value::double as ema, value as running from e where pos = 0 union all select e.user_id, e.pos, e.ts, e.value * 2.0 / {_N + 1} + m.ema * (1 - 2.0 / {_N + 1}), m.running + e.value from m join e on e.user_id = m.user_id and e.pos = m.pos + 1)
    select user_id, pos, round(running, 4) as running, round(ema, 6) as ema from m""",
)
def _(spark, folder):
    from ..streaming.append import into_table, running_state

    schema = _table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    out, marks = new_folder(spark, "stream"), new_folder(spark, "stream-marks")
    into_table(running_state(stream, "user_id", "ts", "value", _N), out, marks)
    return spark.read.parquet(out).where("not late").select(F.col("key").alias("user_id"), "pos", F.round("running", 4).alias("running"), r6("ema").alias("ema"))


@query("stream_windows", "select event_type, date_trunc('day', ts) as start, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by all")
def _(spark, folder):
    from ..streaming.append import whole_table, windowed_totals

    schema = _table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    out, marks = new_folder(spark, "stream"), new_folder(spark, "stream-marks")
    totals = windowed_totals(stream.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", "value", "1 day", "1 hour")
    whole_table(totals, out, marks)
    return spark.read.schema("event_type string, start timestamp, n long, total double").parquet(out).withColumn("total", F.round("total", 4))


#: Days of events that arrive together; every twentieth event arrives with the next lot.
_LOT_DAYS = 10
_LOTS = f"""lots as (select *, date_diff('day', date '2024-01-01', ts::date) // {_LOT_DAYS} + (event_id % 20 = 0)::int as lot from events),
    seen as (select *, max(ts) over (partition by user_id order by lot range between unbounded preceding and 1 preceding) as before from lots),
    g as (select *, row_number() over (partition by user_id order by lot, ts) - 1 as pos from seen where before is null or ts >= before)"""


def _lots(spark, folder) -> tuple[DataFrame, str]:
    """A stream of the events in lots, one file and micro-batch each."""
    events = _table(spark, folder, "events")
    lot = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / _LOT_DAYS) + (F.col("event_id") % 20 == 0).cast("int")
    marked, path = events.withColumn("lot", lot), new_folder(spark, "lots")
    low, high = marked.agg(F.min("lot"), F.max("lot")).first()
    for k in range(low, high + 1):
        marked.where(F.col("lot") == k).drop("lot").coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path), path


@query(
    "stream_lots",
    f"""with recursive {_LOTS},
    m as (select user_id, pos, ts, value::double as ema, value::double as atr, value as running from g where pos = 0 union all
          select g.user_id, g.pos, g.ts, g.value * 2.0 / {_N + 1} + m.ema * (1 - 2.0 / {_N + 1}), (m.atr * (least(g.pos + 1, {_N}) - 1) + g.value) / least(g.pos + 1, {_N}), m.running + g.value from m join g on g.user_id = m.user_id and g.pos = m.pos + 1)
    select s.user_id, epoch_us(s.ts) as us, m.pos is null as late, coalesce(m.pos, -1) as pos, round(running, 4) as running, round(ema, 6) as ema, round(atr, 6) as atr,
           case when m.pos is not null then min(s.value) filter (m.pos is not null) over w end as low, case when m.pos is not null then round(var_pop(s.value) filter (m.pos is not null) over w + 1e-7, 3) end as var
    from seen s left join m on s.user_id = m.user_id and s.ts = m.ts window w as (partition by s.user_id order by s.lot, s.ts rows unbounded preceding)""",
)
def _(spark, folder):
    from ..streaming.append import into_table, running_state

    stream, _ = _lots(spark, folder)
    out, marks = new_folder(spark, "stream"), new_folder(spark, "stream-marks")
    into_table(running_state(stream, "user_id", "ts", "value", _N), out, marks)
    found = spark.read.parquet(out)
    known = lambda c, digits: F.when(~F.col("late"), F.round(c, digits)).alias(c)
    return found.select(F.col("key").alias("user_id"), micros(found, "ts").alias("us"), "late", "pos", known("running", 4), known("ema", 6), known("atr", 6), F.when(~F.col("late"), F.col("low")).alias("low"), F.when(~F.col("late"), F.round(F.col("var") + HALF, 3)).alias("var"))


@query("stream_grid", f"with {_LOTS}, p as (select user_id, value, row_number() over (partition by user_id order by lot, ts) - 1 as pos from lots) select user_id, pos // 6 as cell, count(*) as n, round(sum(value), 4) as total, min(value) as low, max(value) as high from p group by user_id, pos // 6 having count(*) = 6")
def _(spark, folder):
    from ..streaming.append import into_table, running_grid

    stream, _ = _lots(spark, folder)
    out, marks = new_folder(spark, "stream"), new_folder(spark, "stream-marks")
    into_table(running_grid(stream, "user_id", "ts", "value", 6), out, marks)
    return spark.read.parquet(out).select(F.col("key").alias("user_id"), "cell", "n", F.round("total", 4).alias("total"), "low", "high")


@query("stream_store", f"with {_LOTS} select user_id, row_number() over (partition by user_id order by pos) - 1 as pos, epoch_us(ts) as us, value from g where {_BETWEEN}")
def _(spark, folder):
    from ..streaming.append import append_to_store

    stream, _ = _lots(spark, folder)
    store = append_to_store(stream, new_folder(spark, "stream-store"), new_folder(spark, "stream-marks"), "user_id", "ts", "value")
    part = store.get(None, _ntz(_FROM), _ntz(_TILL)).series
    return part.df.select("user_id", "pos", micros(part.df, "ts").alias("us"), "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
