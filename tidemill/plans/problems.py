"""Queries of the general data problems over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeaxis import day_string, micros
from ..operators.gridfill import regular_grid
from ..operators.implausible import implausible, quote_limits
from ..operators.readings import quote_loads, quote_readings
from ..operators.rolling import amount_columns, build, correct, current, spans
from ..operators.sessions import sessions
from ..operators.skew import frequent_values, salted_aggregate, unpivot_values
from .cut import table_cut

SESSION_GAP_US = 30 * 60 * 1_000_000
#: Longest stretch of days over which a close is interpolated.
MAX_GAP_DAYS = 10


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _close_grid(spark: SparkSession, folder: str) -> DataFrame:
    closes = quote_readings(_table(spark, folder, "quotes"), ["close"])
    open_days = _table(spark, folder, "trading_days").where("is_open").select("cal_day")
    return regular_grid(closes, "symbol", "day", "close", calendar=open_days, calendar_time="cal_day", max_gap=MAX_GAP_DAYS)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Open days on which a symbol has no close."""
    return _close_grid(spark, folder).where("status <> 'reading'").select("symbol", day_string(F.col("t")).alias("day"))


def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Closes on every open day, interpolated within the gap limit."""
    grid = _close_grid(spark, folder)
    return grid.select("symbol", day_string(F.col("t")).alias("day"), "status", F.round("filled", 4).alias("filled"), (F.col("next_t") - F.col("prev_t")).alias("gap_days"))


def _crash_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(_table(spark, folder, "crashlog").where("uid > 0"), "uid", "log_time", SESSION_GAP_US)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the crash log."""
    return _crash_sessions(spark, folder).select("uid", "start_us", "end_us")


def p3_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with duration and number of rows."""
    return _crash_sessions(spark, folder)


def _quote_cases(spark: SparkSession, folder: str, chunk: int | None = None) -> DataFrame:
    fields = ["high", "low", "close", "volume"]
    readings = quote_readings(_table(spark, folder, "quotes"), fields)
    return implausible(readings, "symbol", "day", fields, quote_limits(), {"close": True, "volume": False}, chunk=chunk)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that can't be true or don't fit their symbol."""
    return _quote_cases(spark, folder).select("symbol", day_string(F.col("t")).alias("day"))


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the reasons."""
    return _quote_cases(spark, folder).select("symbol", day_string(F.col("t")).alias("day"), "limits", "spike", "stuck")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The same with every symbol's values in pieces, as longer sources need it."""
    return _quote_cases(spark, folder, 500).select("symbol", day_string(F.col("t")).alias("day"), "limits", "spike", "stuck")


VALUE_COLUMNS = ["country", "device", "net"]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that more than 5 % of a month's rows have."""
    log = _table(spark, folder, "crashlog")
    found = frequent_values(log, F.date_format("log_time", "yyyy-MM"), VALUE_COLUMNS, 0.05)
    return found.select(F.col("period").alias("ym"), "col_name", "col_value")


def p6_per_value(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, different uids, first and last time of every value of the skewed columns and of every uid."""
    log = _table(spark, folder, "crashlog")
    rows = log.withColumn("us", micros(log, "log_time"))
    values = unpivot_values(rows, [*VALUE_COLUMNS, "uid"], ["uid", "us"])
    wanted = {"n_rows": ("count", None), "n_uids": ("distinct", "uid"), "first_us": ("min", "us"), "last_us": ("max", "us")}
    return salted_aggregate(values, ["col_name", "col_value"], wanted)


PERIODS = [7, 30]


#: Days after which a load counts as late; what it changes is a correction.
LATE_DAYS = 1


def _quote_versions(spark: SparkSession, folder: str, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, corrections, days) of the quotes: version 1 from the loads on time, version 2 of the days that late loads touch."""
    loads = quote_loads(_table(spark, folder, "quotes"), names, LATE_DAYS)
    # a negative or absent volume is 0
    values = lambda load: {n: F.greatest(F.coalesce(F.col(f"{load}.{n}"), F.lit(0)), F.lit(0)) if n == "volume" else F.col(f"{load}.{n}") for n in names}
    latest, first = amount_columns(loads, values("latest")), amount_columns(loads, values("first"))
    # a day without a load on time has nothing yet
    first = {m: F.when(F.col("first").isNotNull(), c).otherwise(F.lit(0)).cast(loads.select(c.alias("c")).schema["c"].dataType) for m, c in first.items()}
    kinds = loads.select(*[c.alias(m) for m, c in latest.items()]).schema
    changes = [(latest[m] - first[m]).cast(kinds[m].dataType).alias(f"{m}_change") for m in latest]
    daily = loads.select(F.col("symbol").alias("entity"), F.unix_date("day").cast("long").alias("day_no"), *[first[m].alias(m) for m in latest], *changes)
    daily = table_cut(daily, "amounts")
    days, late = spans(daily), daily.select("entity", "day_no", *[F.col(f"{m}_change").alias(m) for m in latest])
    state = table_cut(build(daily.select("entity", "day_no", *latest), PERIODS, days), "state")
    changed = F.lit(False)
    for m in latest:
        changed = changed | (F.col(m) != 0)
    return state, correct(state, late.where(changed), PERIODS, 2), days


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days whose last 7 days hold more than half of the volume of the last 30."""
    state, corrections, days = _quote_versions(spark, folder, ["volume"])
    hits = current(state, corrections).where(2 * F.col("volume_sum_7") > F.col("volume_sum_30"))
    found = hits.join(days.select("entity", "first_day"), "entity").where(F.col("day_no") >= F.col("first_day") + 29)
    return found.select(F.col("entity").alias("symbol"), day_string(F.col("day_no")).alias("day"))


def p7_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """The days that late loads touch, with their new totals."""
    corrections = _quote_versions(spark, folder, ["volume", "close"])[1]
    return corrections.select(F.col("entity").alias("symbol"), day_string(F.col("day_no")).alias("day"), "version", *[F.col(f"volume_sum_{p}").cast("long").alias(f"volume_total_{p}") for p in PERIODS])


def p7_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and averages of volume and close over the last 7 and 30 days, for every day of a symbol."""
    state, corrections, _ = _quote_versions(spark, folder, ["close", "volume"])
    state = current(state, corrections)
    cols = []
    for p in PERIODS:
        cols += [
            F.col(f"volume_sum_{p}").cast("long").alias(f"volume_total_{p}"),
            F.round(F.col(f"volume_sum_{p}").cast("double") / p, 4).alias(f"volume_mean_{p}"),
            F.col(f"close_n_{p}").alias(f"close_count_{p}"),
            F.when(F.col(f"close_n_{p}") > 0, F.round(F.round(F.col(f"close_sum_{p}"), 2).cast("double") / F.col(f"close_n_{p}"), 6)).alias(f"close_mean_{p}"),
        ]
    return state.select(F.col("entity").alias("symbol"), day_string(F.col("day_no")).alias("day"), *cols)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_grid, p3_found, p3_sessions, p5_found, p5_reasons, p5_pieces, p6_found, p6_per_value, p7_found, p7_rolling, p7_corrections)}


_READINGS = """
r as (select upper(trim(symbol)) as symbol, day, open, high, low, close, volume from quotes where symbol is not null and day is not null
      qualify row_number() over (partition by upper(trim(symbol)), day order by loaded_at desc nulls last, high desc nulls last, low desc nulls last, close desc nulls last, volume desc nulls last) = 1)
"""

_GRID = f"""
with {_READINGS},
c as (select symbol, day, close::double as v from r where close is not null and not isnan(close)),
s as (select symbol, min(day) as a, max(day) as b from c group by symbol),
g as (select symbol, cal_day as d from s join trading_days on cal_day between a and b and is_open),
p as (select g.symbol, g.d, c.day as pd, c.v as pv from g asof join c on g.symbol = c.symbol and g.d >= c.day),
n as (select p.*, c.day as nd, c.v as nv from p asof join c on p.symbol = c.symbol and p.d <= c.day)
"""

_SESSIONS = """
with e as (select uid, epoch_us(log_time) as t from crashlog where uid > 0 and log_time is not null),
m as (select *, case when t - lag(t) over w <= 1800000000 then 0 else 1 end as new from e window w as (partition by uid order by t)),
k as (select *, sum(new) over (partition by uid order by t rows unbounded preceding) as k from m),
s as (select uid, min(t) as start_us, max(t) as end_us, max(t) - min(t) as duration_us, count(*) as n_events from k group by uid, k.k)
"""

_STATE = f"""
with {_READINGS},
s as (select symbol, min(day) as a, max(day) as b from r group by symbol),
d as (select s.symbol, s.a, unnest(generate_series(s.a, s.b, interval 1 day))::date as day from s),
x as (select d.symbol, d.a, d.day, greatest(coalesce(r.volume, 0), 0)::bigint as v,
             case when isfinite(r.close) and abs(r.close) <= 1e24 then r.close::double::decimal(38, 6) end as c
      from d left join r on d.symbol = r.symbol and d.day = r.day),
w as (select symbol, a, day,
        sum(v) over w7 as v7, sum(v) over w30 as v30, count(c) over w7 as n7, count(c) over w30 as n30, sum(c) over w7 as s7, sum(c) over w30 as s30
      from x window w7 as (partition by symbol order by day range between interval 6 days preceding and current row),
                    w30 as (partition by symbol order by day range between interval 29 days preceding and current row))
"""


_LOADS = f"""
with {_READINGS},
o as (select upper(trim(symbol)) as symbol, day, close, volume from quotes where symbol is not null and day is not null and coalesce(date_diff('day', day, loaded_at::date) <= {LATE_DAYS}, true)
      qualify row_number() over (partition by upper(trim(symbol)), day order by loaded_at desc nulls last, close desc nulls last, volume desc nulls last) = 1),
t as (select r.symbol, r.day, greatest(coalesce(r.volume, 0), 0)::bigint as v,
             (o.symbol is null or greatest(coalesce(r.volume, 0), 0) <> greatest(coalesce(o.volume, 0), 0)
              or (case when isfinite(r.close) then r.close::double::decimal(38, 6) end) is distinct from (case when isfinite(o.close) then o.close::double::decimal(38, 6) end))::int as c
      from r left join o on r.symbol = o.symbol and r.day = o.day),
s as (select symbol, min(day) as a, max(day) as b from r group by symbol),
d as (select symbol, unnest(generate_series(a, b, interval 1 day))::date as day from s),
w as (select d.symbol, d.day, sum(coalesce(v, 0)) over w7 as v7, sum(coalesce(v, 0)) over w30 as v30, sum(coalesce(c, 0)) over w30 as c30 from d left join t using (symbol, day)
      window w7 as (partition by symbol order by day range between interval 6 days preceding and current row), w30 as (partition by symbol order by day range between interval 29 days preceding and current row))
"""


def _spike_sql() -> str:
    parts = []
    for f in ("high", "low", "close", "volume"):
        parts.append(
            f"""
        v_{f} as (select symbol, day, ln({f}::double) as y, row_number() over (partition by symbol order by day) as i from r where isfinite({f}::double) and {f} > 0),
        t_{f} as (select symbol, median(d) as typ from (select symbol, abs(y - lag(y) over (partition by symbol order by day)) as d from v_{f}) where d > 0 group by symbol),
        h_{f} as (select symbol, i, n from (select symbol, i, n, y,
                    least(y, case when n > 1 then lead(y, 1) over w else y end, case when n > 2 then lead(y, 2) over w else y end) as lo,
                    greatest(y, case when n > 1 then lead(y, 1) over w else y end, case when n > 2 then lead(y, 2) over w else y end) as hi,
                    lag(y) over w as b, case n when 1 then lead(y, 1) over w when 2 then lead(y, 2) over w else lead(y, 3) over w end as a
                  from v_{f} cross join (select unnest([1, 2, 3]) as n) window w as (partition by symbol, n order by day)) join t_{f} using (symbol)
                  where b is not null and a is not null and greatest(lo - greatest(a, b), least(a, b) - hi) > 8 * typ),
        f_{f} as (select distinct v.symbol, v.day from h_{f} h join v_{f} v on v.symbol = h.symbol and v.i between h.i and h.i + h.n - 1)"""
        )
    return ",".join(parts)


def _stuck_sql(field: str) -> str:
    return f"""
        q_{field} as (select symbol, day, {field} as x, case when {field} = lag({field}) over (partition by symbol order by day) then 0 else 1 end as new
                      from r where {field} is not null and not isnan({field}::double)),
        k_{field} as (select *, sum(new) over (partition by symbol order by day rows unbounded preceding) as k from q_{field}),
        l_{field} as (select symbol, k, count(*) as n, min(x) as x from k_{field} group by symbol, k),
        o_{field} as (select symbol from l_{field} group by symbol
                      having coalesce(sum(case when n < 5 then n - 1 else 0 end) / nullif(sum(n) - 1 - sum(case when n >= 5 then n - 1 else 0 end), 0), 0) <= 0.05),
        s_{field} as (select symbol, day from k_{field} join l_{field} using (symbol, k) join o_{field} using (symbol) where n >= 5{" and l_volume.x <> 0" if field == "volume" else ""})"""


_CASES = f"""
with {_READINGS}, {_spike_sql()}, {_stuck_sql("close")}, {_stuck_sql("volume")},
lim as (select symbol, day from r where
    (high is not null and not (isfinite(high) and high > 0)) or (low is not null and not (isfinite(low) and low > 0)) or (close is not null and not (isfinite(close) and close > 0))
    or high < low or close > high or close < low or volume < 0),
every as (select symbol, day, 1 as l, 0 as s, 0 as u from lim
    union all select symbol, day, 0, 1, 0 from f_high union all select symbol, day, 0, 1, 0 from f_low union all select symbol, day, 0, 1, 0 from f_close union all select symbol, day, 0, 1, 0 from f_volume
    union all select symbol, day, 0, 0, 1 from s_close union all select symbol, day, 0, 0, 1 from s_volume),
found as (select symbol, strftime(day, '%Y-%m-%d') as day, max(l) = 1 as limits, max(s) = 1 as spike, max(u) = 1 as stuck from every group by symbol, day)
"""

_VALUES = """
with v as (select * from (select log_time, uid, unnest(['country', 'device', 'net', 'uid']) as col_name, unnest([country, device, net, uid::varchar]) as col_value from crashlog))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_GRID} select symbol, strftime(d, '%Y-%m-%d') as day from n where pd <> d",
        "p1_grid": f"""{_GRID} select symbol, strftime(d, '%Y-%m-%d') as day, (nd - pd)::bigint as gap_days,
            case when pd = d then 'reading' when nd - pd <= {MAX_GAP_DAYS} and isfinite(pv) and isfinite(nv) then 'filled' else 'missing' end as status,
            round(case when pd = d then pv when nd - pd <= {MAX_GAP_DAYS} and isfinite(pv) and isfinite(nv) then pv + (nv - pv) * ((d - pd) / (nd - pd)) end, 4) as filled from n""",
        "p3_found": f"{_SESSIONS} select uid, start_us, end_us from s",
        "p3_sessions": f"{_SESSIONS} select * from s",
        "p5_found": f"{_CASES} select symbol, day from found",
        "p5_reasons": f"{_CASES} select * from found",
        "p5_pieces": f"{_CASES} select * from found",
        "p6_found": f"""{_VALUES}, m as (select strftime(log_time, '%Y-%m') as ym, col_name, col_value from v where log_time is not null and col_name <> 'uid')
            select ym, col_name, col_value from (select *, count(*) as n, sum(count(*)) over (partition by ym, col_name) as total from m group by ym, col_name, col_value)
            where col_value is not null and n > 0.05 * total""",
        "p6_per_value": f"{_VALUES} select col_name, col_value, count(*) as n_rows, count(distinct uid) as n_uids, min(epoch_us(log_time)) as first_us, max(epoch_us(log_time)) as last_us from v group by col_name, col_value",
        "p7_found": f"{_STATE} select symbol, strftime(day, '%Y-%m-%d') as day from w where day >= a + 29 and 2 * v7 > v30",
        "p7_corrections": f"{_LOADS} select symbol, strftime(day, '%Y-%m-%d') as day, 2::bigint as version, v7::bigint as volume_total_7, v30::bigint as volume_total_30 from w where c30 > 0",
        "p7_rolling": f"""{_STATE} select symbol, strftime(day, '%Y-%m-%d') as day, v7::bigint as volume_total_7, v30::bigint as volume_total_30, round(v7 / 7, 4) as volume_mean_7, round(v30 / 30, 4) as volume_mean_30,
            n7::bigint as close_count_7, n30::bigint as close_count_30, case when n7 > 0 then round(round(s7, 2)::double / n7, 6) end as close_mean_7, case when n30 > 0 then round(round(s30, 2)::double / n30, 6) end as close_mean_30 from w""",
    }
