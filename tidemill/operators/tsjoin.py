"""Joins of series by time.

A probe is a row of the left side, with the ids and a time on a whole-number
axis; the right side is a series of times and values. Neighbours are found by a
merge of both sides sorted by time, never by pairing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equi(left: DataFrame, right: DataFrame, ids: list[str], t: str, value: str) -> DataFrame:
    """Rows of right whose time is on both sides, as (ids, t, value, left_pos, right_pos). Equal times pair one to one in order of position."""
    number = lambda df: F.row_number().over(Window.partitionBy(*ids, t).orderBy("pos"))
    a = left.select(*ids, t, F.col("pos").alias("left_pos"), number(left).alias("_k"))
    b = right.select(*ids, t, value, F.col("pos").alias("right_pos"), number(right).alias("_k"))
    return a.join(b, [*ids, t, "_k"]).select(*ids, t, value, "left_pos", "right_pos")


def neighbours(left: DataFrame, right: DataFrame, ids: list[str], t: str, payload: list[str], strict: bool = False, chunk: int | None = None) -> DataFrame:
    """Every left row with ``prev`` and ``next``: structs (t, payload) of the last right row at or before its time and the first at or after it.

    strict leaves out right rows of the very time from ``next``. Of several right
    rows of one time, prev takes the last by payload and next the first. t is a
    whole number. Rows with a null time are left out of both sides.

    Ids are the units of work; with ``chunk``, stretches of that many time units
    are, and what a stretch needs of the others is one row per stretch.
    """
    keep = [c for c in left.columns if c not in (*ids, t)]
    kind = F.struct(F.col(t).alias("t"), *payload)
    own = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(1).alias("_one"))
    a = left.where(F.col(t).isNotNull()).select(*ids, F.col(t).alias("_t"), own.alias("_own"))
    b = right.where(F.col(t).isNotNull()).select(*ids, F.col(t).alias("_t"), kind.alias("_r"))
    part = list(ids)
    if chunk:
        cell = F.floor(F.col("_t") / chunk).cast("long").alias("_c")
        a, b = a.select("*", cell), b.select("*", cell)
        ends = b.groupBy(*ids, "_c").agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"))
        cells = ends.unionByName(a.select(*ids, "_c").distinct(), allowMissingColumns=True).groupBy(*ids, "_c").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
        order = Window.partitionBy(*ids).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        back = Window.partitionBy(*ids).orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = cells.select(*ids, "_c", F.last("_last", ignorenulls=True).over(order).alias("_before"), F.last("_first", ignorenulls=True).over(back).alias("_after"))
        # as right rows of the stretch, so that null ids are a stretch like any other
        carried = carried.select(*ids, "_c", F.explode(F.array("_before", "_after")).alias("_r")).where("_r is not null")
        b = b.unionByName(carried.select(*ids, F.col("_r.t").alias("_t"), "_r", "_c"))
        part.append("_c")
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*part)
    # in order of time and then payload, right rows of the very time among those that count
    upto = w.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    onward = w.orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    both = both.withColumn("prev", F.max("_r").over(upto)).withColumn("next", F.min("_r").over(onward)).where("_own is not null")
    return both.select(*ids, F.col("_t").alias(t), *[F.col(f"_own.{c}").alias(c) for c in keep], "prev", "next")


def nearest(found: DataFrame, t: str, field: str, out: str, farther: bool = False) -> DataFrame:
    """The field of the nearer neighbour, of two equally near the earlier. ``farther`` takes the other one where there are two (for results that expect it)."""
    p, n = F.col("prev"), F.col("next")
    near = (F.col(t) - p["t"]) <= (n["t"] - F.col(t))
    if farther:
        pick = F.when(near & (p["t"] != F.col(t)), n[field]).otherwise(p[field])
    else:
        pick = F.when(near, p[field]).otherwise(n[field])
    return found.withColumn(out, F.when(p.isNull(), n[field]).when(n.isNull(), p[field]).otherwise(pick)).drop("prev", "next")


def point(left: DataFrame, right: DataFrame, ids: list[str], t: str, direction: int, on_miss: str = "error") -> DataFrame:
    """Position in right of each probe: the first time at or after it (1), the very time (0) or the last at or before it (-1). A probe without one is an error, or null."""
    found = neighbours(left, right, ids, t, ["pos"])
    last_first = {1: F.col("next.pos"), -1: F.col("prev.pos"), 0: F.when(F.col("next.t") == F.col(t), F.col("next.pos"))}[direction]
    if on_miss == "error":
        last_first = F.when(last_first.isNull(), F.raise_error(F.concat(F.lit("no element at time "), F.col(t).cast("string"))).cast("long")).otherwise(last_first)
    return found.withColumn("right_pos", last_first).drop("prev", "next")


def stretch(left: DataFrame, right: DataFrame, ids: list[str], t: str, value: str, filler: Column) -> DataFrame:
    """For each left time the value of the first right time after it, else the filler."""
    found = neighbours(left, right, ids, t, [value], strict=True)
    return found.withColumn(value, F.coalesce(F.col(f"next.{value}"), filler)).drop("prev", "next")


def stretch0(left: DataFrame, right: DataFrame, ids: list[str], t: str, value: str, filler: Column) -> DataFrame:
    """All times of both sides: right's values, the filler where only left has the time."""
    a = left.select(*ids, t).distinct()
    return a.join(right.select(*ids, t, value, F.lit(True).alias("_have")), [*ids, t], "full").withColumn(value, F.when(F.col("_have"), F.col(value)).otherwise(filler)).drop("_have")


def gather(series: DataFrame, positions: DataFrame, ids: list[str], pos: str, value: str) -> DataFrame:
    """Elements at given positions, in the order of ``positions`` (its column k); positions outside give nothing."""
    return positions.join(series.select(*ids, pos, value), [*ids, pos])
