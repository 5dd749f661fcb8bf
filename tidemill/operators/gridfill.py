"""Irregular readings onto a regular grid: an as-of merge with neighbours on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeaxis import MICROS_A_DAY, axis


#: Grid points that are made from one row at a time.
BLOCK_POINTS = 4096


def regular_grid(
    readings: DataFrame, source: str, time: str, value: str, step: int = 1, calendar: DataFrame | None = None, calendar_time: str | None = None,
    max_gap: int | None = None, chunk: int | None = None,
) -> DataFrame:
    """Grid points of each source from its first to its last reading.

    Result: source, t (days of a date, microseconds of a timestamp), value (of a
    reading at that very time, else null), prev_t, prev_value, next_t, next_value
    (the nearest readings at or before and at or after), filled (the reading, or
    the time-weighted linear interpolation where next_t - prev_t is at most
    ``max_gap``, no limit if None, else null) and status: 'reading', 'filled' or
    'missing'.

    The grid has a point every ``step``, aligned to multiples of it, or, with a
    calendar, at its distinct times, whatever the step. A reading is a row with source and time whose
    value is neither null nor not-a-number; of several at one time the greatest
    value counts. A source without readings has no grid; infinite neighbours give
    no interpolation, so the point is missing.

    A series is cut into chunks of ``chunk`` time units, and a chunk with the grid
    points up to the next chunk's first reading is one unit of work, so a source
    with most of the rows is spread like any other. The last and first readings
    that a chunk needs of its neighbours come from one row per chunk.
    """
    kind = readings.schema[value].dataType
    size = chunk or (366 if isinstance(readings.schema[time].dataType, T.DateType) else 7 * MICROS_A_DAY)
    rows = readings.select(F.col(source).alias("source"), axis(readings, time).alias("t"), F.col(value).cast("double").alias("v"))
    rows = rows.where("source is not null and t is not null and v is not null and not isnan(v)")
    # of equal times the greatest value counts: the greatest (t, v) looking back, the least (t, -v) looking ahead
    rows = rows.select("source", F.floor(F.col("t") / size).cast("long").alias("chunk"), "t", F.struct("t", "v").alias("r"), F.struct("t", (-F.col("v")).alias("v")).alias("ahead"))
    ends = rows.groupBy("source", "chunk").agg(F.min("ahead").alias("first"), F.max("t").alias("last_t"))
    order = Window.partitionBy("source").orderBy("chunk")
    ends = ends.withColumn("after", F.lead("first").over(order))
    until = F.when(F.col("after").isNull(), F.col("last_t")).otherwise(F.col("after.t") - 1)
    span = ends.withColumn("until", until)
    if calendar is None:
        span = span.withColumn("start", F.ceil(F.col("first.t") / step).cast("long") * step).where("start <= until")
        # in blocks, so that a long gap isn't one array of all its points
        block = F.lit(BLOCK_POINTS * step).cast("long")
        begun = span.select("source", "chunk", "after", "until", F.explode(F.sequence("start", "until", block)).alias("b"))
        points = begun.select("source", "chunk", "after", F.explode(F.sequence("b", F.least(F.col("b") + block - step, F.col("until")), F.lit(step).cast("long"))).alias("t"))
    else:
        # a calendar time meets the chunks whose spans reach into its cell of the time axis
        cell = lambda t: F.floor(t / size).cast("long")
        times = calendar.select(axis(calendar, calendar_time).alias("t")).where("t is not null").distinct().withColumn("cell", cell(F.col("t")))
        reached = span.withColumn("cell", F.explode(F.sequence(cell(F.col("first.t")), cell(F.col("until")))))
        points = reached.join(times, "cell").where("t between first.t and until").select("source", "chunk", "after", "t")
    pair = "struct<t:bigint,v:double>"
    grid = points.select("source", "chunk", "t", F.lit(None).cast(pair).alias("r"), F.lit(None).cast(pair).alias("ahead"), F.col("after").cast(pair).alias("after"), F.lit(True).alias("on_grid"))
    own = rows.select("source", "chunk", "t", "r", "ahead", F.lit(None).cast(pair).alias("after"), F.lit(False).alias("on_grid"))
    part = Window.partitionBy("source", "chunk")
    # running frames only: a frame that ends at the last row would be recomputed for every row
    upto = part.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    onward = part.orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    merged = own.unionByName(grid).withColumn("prev", F.max("r").over(upto)).withColumn("next", F.min("ahead").over(onward))
    out = merged.where("on_grid").withColumn("next", F.coalesce("next", "after"))
    p_t, p_v, n_t, n_v = F.col("prev.t"), F.col("prev.v"), F.col("next.t"), -F.col("next.v")
    weight = (F.col("t") - p_t) / F.nullif(n_t - p_t, F.lit(0))
    line = p_v + (n_v - p_v) * weight
    near = F.lit(True) if max_gap is None else (n_t - p_t) <= max_gap
    finite = (F.abs(p_v) < float("inf")) & (F.abs(n_v) < float("inf"))
    at = p_t == F.col("t")
    filled = F.when(at, p_v).when(near & finite, line)
    return out.select(
        F.col("source").alias(source), "t", F.when(at, p_v).cast(kind).alias("value"), p_t.alias("prev_t"), p_v.alias("prev_value"), n_t.alias("next_t"), n_v.alias("next_value"),
        filled.alias("filled"), F.when(at, "reading").when(filled.isNotNull(), "filled").otherwise("missing").alias("status"),
    )
