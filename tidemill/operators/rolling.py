"""Totals and averages over trailing days, kept as a versioned daily state.

The state of a day is the total of each trailing period. It follows from the
state of the day before by adding the day's arrivals and taking away the amounts
of the day that leaves the period. ``advance`` does that for a stretch of days;
``build`` cuts an entity's days into stretches, finds the state of each eve, and
advances all stretches side by side, so that no entity is one unit of work.
``correct`` recomputes the days that a late or changed amount touches and gives
them a new version; ``current`` reads the newest one.

Whole amounts are long, others decimals, so that adding and taking away leaves no
rounding behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNT = "decimal(38,6)"
#: Larger amounts than this can't be summed exactly and count as absent.
LARGEST = 1e24
#: Days that ``build`` takes as one unit of work.
STRETCH = 366


def amount(c: Column, whole: bool = False) -> Column:
    """A value as an exact amount; null, not-a-number, infinite and beyond LARGEST give null."""
    x = c.cast("double")
    return c.cast("long") if whole else F.when(~F.isnan(x) & (F.abs(x) <= LARGEST), x.cast(AMOUNT))


def _whole(readings: DataFrame, values: dict[str, Column]) -> dict[str, bool]:
    kinds = readings.select(*[c.alias(n) for n, c in values.items()]).schema
    return {n: isinstance(kinds[n].dataType, T.IntegralType) for n in values}


def amount_columns(readings: DataFrame, values: dict[str, Column]) -> dict[str, Column]:
    """The columns <name>_sum and <name>_n of readings that are one row per entity and day already."""
    whole = _whole(readings, values)
    out = {}
    for n, c in values.items():
        x = amount(c, whole[n])
        out |= {f"{n}_sum": F.coalesce(x, F.lit(0)).cast("long" if whole[n] else AMOUNT), f"{n}_n": x.isNotNull().cast("long")}
    return out


def daily_amounts(readings: DataFrame, entity: str, day: str, values: dict[str, Column]) -> DataFrame:
    """(entity, day_no, <name>_sum, <name>_n, ...) per entity and day; day_no is days since 1970-01-01. Sums of no value are 0."""
    whole = _whole(readings, values)
    picked = readings.select(F.col(entity).alias("entity"), F.col(day).alias("_day"), *[amount(c, whole[n]).alias(n) for n, c in values.items()])
    sums = [x for n in values for x in (F.coalesce(F.sum(n), F.lit(0)).cast("long" if whole[n] else AMOUNT).alias(f"{n}_sum"), F.count(n).cast("long").alias(f"{n}_n"))]
    # grouped by the columns as they come: readings that are already one row per entity and day aren't shuffled again
    daily = picked.where("entity is not null and _day is not null").groupBy("entity", "_day").agg(*sums)
    return daily.select("entity", F.unix_date("_day").cast("long").alias("day_no"), *[f"{n}_{x}" for n in values for x in ("sum", "n")])


def spans(daily: DataFrame) -> DataFrame:
    """(entity, first_day, last_day): the days of each entity, without activity among them."""
    return daily.groupBy("entity").agg(F.min("day_no").alias("first_day"), F.max("day_no").alias("last_day"))


def _measures(daily: DataFrame) -> list[str]:
    return [c for c in daily.columns if c not in ("entity", "day_no")]


def _states(daily: DataFrame, periods: list[int]) -> dict[str, tuple[str, int, T.DataType]]:
    """State columns: measure, period and type of each."""
    return {f"{m}_{p}": (m, p, daily.schema[m].dataType) for m in _measures(daily) for p in periods}


def _stretch(day: Column, length: int) -> Column:
    return F.floor(day / length).cast("long")


def advance(yesterday: DataFrame, daily: DataFrame, days: DataFrame, periods: list[int], length: int = 1, version: int = 1) -> DataFrame:
    """States of ``days`` from yesterday's totals, the arrivals and the amounts that expire.

    days: (entity, first_day, last_day), each within one stretch of ``length``
    days (multiples of it; 1: single days). yesterday: the state of the day before
    first_day, (entity, day_no, <measure>_<period>...); none counts as zeros. daily:
    amounts, of which those of the days themselves and of a period before are
    needed. Result: entity, day_no, version and <measure>_<period> for every
    measure and period.

    Within a stretch a day's state is the running sum of what came before: the eve's
    totals, every amount on its day, and every amount taken away one period later.
    """
    states, measures = _states(daily, periods), _measures(daily)
    # a row adds its amounts to one period, or to all (0); the days to bring add nothing (-1)
    row = lambda day, period, values: F.struct(day.cast("long").alias("day"), F.lit(period).alias("period"), *[v.cast(daily.schema[m].dataType).alias(m) for m, v in zip(measures, values)])
    moves = F.array(row(F.col("day_no"), 0, [F.col(m) for m in measures]), *[row(F.col("day_no") + p, p, [-F.col(m) for m in measures]) for p in periods])
    moved = daily.select("entity", F.inline(moves)).withColumn("stretch", _stretch(F.col("day"), length))
    eve = yesterday.select("entity", F.inline(F.array(*[row(F.col("day_no"), p, [F.col(f"{m}_{p}") for m in measures]) for p in periods]))).withColumn("stretch", _stretch(F.col("day") + 1, length))
    every = days.select("entity", _stretch(F.col("first_day"), length).alias("stretch"), F.explode(F.sequence("first_day", "last_day")).alias("d"))
    grid = every.select("entity", "stretch", F.inline(F.array(row(F.col("d"), -1, [F.lit(None)] * len(measures)))))
    upto = Window.partitionBy("entity", "stretch").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    total = lambda m, p: F.sum(F.when(F.col("period").isin(0, p), F.col(m))).over(upto)
    run = moved.unionByName(eve).unionByName(grid).select("entity", "day", "period", *[F.coalesce(total(m, p), F.lit(0)).cast(k).alias(s) for s, (m, p, k) in states.items()])
    return run.where("period = -1").select("entity", F.col("day").alias("day_no"), F.lit(version).cast("long").alias("version"), *states)


def build(daily: DataFrame, periods: list[int], days: DataFrame | None = None, length: int = STRETCH, version: int = 1) -> DataFrame:
    """State of every entity and day of ``days`` (``spans`` of daily unless given), days without activity among them.

    The days are advanced in stretches of ``length``, at least the longest period.
    The totals on the eve of a stretch are those of the amounts of the last days
    before it, so no stretch waits for another.
    """
    if length < max(periods):
        raise ValueError("a stretch must be as long as the longest period")
    known = spans(daily) if days is None else days
    start = F.col("stretch") * length
    parts = known.select("*", F.explode(F.sequence(_stretch(F.col("first_day"), length), _stretch(F.col("last_day"), length))).alias("stretch"))
    parts = parts.select("entity", F.greatest("first_day", start).alias("first_day"), F.least("last_day", start + length - 1).alias("last_day"))
    begins = (_stretch(F.col("day_no"), length) + 1) * length
    left = begins - F.col("day_no")  # 1 on the eve
    totals = [F.sum(F.when(left <= p, F.col(m))).cast(k).alias(s) for s, (m, p, k) in _states(daily, periods).items()]
    eves = daily.where(left <= max(periods)).groupBy("entity", (begins - 1).alias("eve")).agg(*totals).withColumnRenamed("eve", "day_no")
    return advance(eves, daily, parts, periods, length, version)


def correct(state: DataFrame, changes: DataFrame, periods: list[int], version: int, length: int = STRETCH) -> DataFrame:
    """New versions of the rows of ``state`` that corrections touch.

    ``changes`` holds differences of daily amounts (new minus old), in the columns
    of daily_amounts. A difference on a day changes each period's totals from that
    day until it leaves the period; only those days are recomputed, by advancing
    the differences alone and adding what they come to. ``state`` has one row per
    entity and day, as build and current give them; days it doesn't have belong to
    build or advance and are left out.
    """
    states, longest = _states(changes, periods), max(periods)
    # a change touches its day and those after it up to the next change or the end of the longest period
    end = F.col("day_no") + longest - 1
    after = F.lead("day_no").over(Window.partitionBy("entity").orderBy("day_no"))
    touched = changes.select("entity", F.col("day_no").alias("first_day"), F.least(after - 1, end).alias("last_day"))
    delta = build(changes, periods, touched, length).select("entity", "day_no", *[F.col(s).alias(f"_{s}") for s in states])
    sums = [(F.col(s) + F.col(f"_{s}")).cast(k).alias(s) for s, (_, _, k) in states.items()]
    return state.join(delta, ["entity", "day_no"]).select("entity", "day_no", F.lit(version).cast("long").alias("version"), *sums)


def current(state: DataFrame, *corrections: DataFrame) -> DataFrame:
    """The newest version of every entity and day: of a state that holds several, or of one and its corrections, the later ones last."""
    if corrections:
        for new in corrections:
            state = state.join(new.select("entity", "day_no"), ["entity", "day_no"], "left_anti").unionByName(new)
        return state
    values = [c for c in state.columns if c not in ("entity", "day_no", "version")]
    best = state.groupBy("entity", "day_no").agg(F.max(F.struct("version", *values)).alias("s"))
    return best.select("entity", "day_no", "s.version", *[F.col(f"s.{v}").alias(v) for v in values])
