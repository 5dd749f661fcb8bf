"""Filters, choices and re-shaping of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import Series


def filter_elements(s: Series, condition: Column) -> Series:
    """Elements for which the condition holds, renumbered."""
    return s.where(condition)


def filter_pos(s: Series, condition: Column) -> DataFrame:
    """Positions at which the condition holds."""
    return s.df.where(condition).select(*s.ids, s.pos)


def filter_first_pos(s: Series, condition: Column, n: int) -> DataFrame:
    """The first n such positions of each id."""
    hits = s.df.where(condition).select(*s.ids, s.pos)
    return hits.withColumn("_k", F.row_number().over(s.w)).where(F.col("_k") <= n).drop("_k")


def iif(condition: Column, a: Column, b: Column) -> Column:
    """a or b of the same position."""
    return F.when(condition, a).otherwise(b)


def choose(s: Series, condition: Column, a: tuple[Series, str], b: tuple[Series, str], out: str = "chosen") -> DataFrame:
    """The next unused element of a where the condition holds, of b elsewhere: the k-th true takes a's k-th element. Ends where the chosen series has no more."""
    true = s.with_column("_t", F.coalesce(condition, F.lit(False)))
    n = true.with_column("_at", F.count_if("_t").over(s.upto)).with_column("_f", F.count_if(~F.col("_t")).over(s.upto))
    asked = n.df.select(*s.ids, s.pos, "_t", (F.when(F.col("_t"), F.col("_at")).otherwise(F.col("_f")) - 1).alias("_k"))
    (sa, va), (sb, vb) = a, b
    have = sa.df.select(*s.ids, F.col(sa.pos).alias("_k"), F.col(va).alias(out), F.lit(True).alias("_t")).unionByName(sb.df.select(*s.ids, F.col(sb.pos).alias("_k"), F.col(vb).alias(out), F.lit(False).alias("_t")))
    return asked.join(have, [*s.ids, "_t", "_k"]).select(*s.ids, s.pos, out)


def limit(s: Series, first: int = 0, last: int | None = None) -> Series:
    """Positions first to last, both included; negative ones count from the end. An empty range gives nothing."""
    size = F.max(s.pos).over(s.whole) + 1
    if first >= 0 and (last is None or last >= 0):
        keep = F.col(s.pos) >= first if last is None else F.col(s.pos).between(first, last)
        return s.where(keep)
    sized = s.with_column("_n", size)
    a = F.lit(first) if first >= 0 else F.col("_n") + first
    b = F.lit(2**62) if last is None else F.lit(last) if last >= 0 else F.col("_n") + last
    cut = sized.where((F.col(s.pos) >= a) & (F.col(s.pos) <= b))
    return Series(cut.df.drop("_n"), s.ids, s.pos)


def head(s: Series, n: int = 1) -> Series:
    return s.where(F.col(s.pos) < n)


def tail(s: Series, n: int = 1) -> Series:
    return limit(s, -n) if n > 0 else s.where(F.lit(False))


def cut_head(s: Series, n: int = 1) -> Series:
    return limit(s, n)


def cut_tail(s: Series, n: int = 1) -> Series:
    return limit(s, 0, -n - 1)


def thin(s: Series, origin: int, step: int) -> Series:
    """Positions origin, origin + step, and so on."""
    return s.where((F.col(s.pos) >= origin) & ((F.col(s.pos) - origin) % step == 0))


def repeat(s: Series, n: int) -> Series:
    """Every element n times."""
    more = s.df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else s.df.where(F.lit(False)).withColumn("_k", F.lit(0))
    return Series(more.withColumn(s.pos, F.col(s.pos) * n + F.col("_k")).drop("_k"), s.ids, s.pos)


def reverse(s: Series) -> Series:
    return s.with_column(s.pos, F.max(s.pos).over(s.whole) - F.col(s.pos))


def unique(s: Series, value: str) -> Series:
    """Without elements equal to the one before."""
    new = F.lag(F.struct(value)).over(s.w).isNull() | ~F.col(value).eqNullSafe(F.lag(value).over(s.w))
    kept = s.with_column("_new", new).where("_new")
    return Series(kept.df.drop("_new"), s.ids, s.pos)


def diff(s: Series, value: str) -> Column:
    """Change from the element before, 0 for the first."""
    return F.coalesce(F.col(value) - F.lag(value).over(s.w), F.lit(0))


def with_trend(s: Series, value: str, out: str = "trend") -> Series:
    """Sign of the last change; a plateau keeps the trend before it; 0 up to the first change."""
    sign = F.signum(F.col(value) - F.lag(value).over(s.w))
    signed = s.with_column("_s", F.when(sign != 0, sign.cast("int")))
    trend = signed.with_column(out, F.coalesce(F.last("_s", ignorenulls=True).over(s.upto), F.lit(0)))
    return Series(trend.df.drop("_s"), s.ids, s.pos)


def norm(s: Series, value: str) -> Column:
    """Elements of the vector of length 1."""
    v = F.col(value).cast("double")
    return v / F.sqrt(F.sum(v * v).over(s.whole))


def is_empty(s: Series) -> bool:
    return s.df.isEmpty()


def concat(a: Series, b: Series) -> Series:
    """b's elements after a's, by id. Ids of one side only keep what they have."""
    left = a.df.withColumn("_side", F.lit(0)).withColumnRenamed(a.pos, "_p")
    right = b.df.withColumn("_side", F.lit(1)).withColumnRenamed(b.pos, "_p")
    both = left.unionByName(right, allowMissingColumns=True)
    # positions follow from a's length, so no id is sorted again
    size = a.df.groupBy(*a.ids).agg(F.count(F.lit(1)).alias("_n")) if a.ids else None
    if size is None:
        n = a.df.count()
        shifted = both.withColumn(a.pos, F.col("_p") + F.when(F.col("_side") == 1, F.lit(n)).otherwise(F.lit(0)))
        return Series(shifted.drop("_side", "_p"), a.ids, a.pos)
    shifted = both.join(size, list(a.ids), "left").withColumn(a.pos, F.col("_p") + F.when(F.col("_side") == 1, F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)))
    return Series(shifted.drop("_side", "_p", "_n"), a.ids, a.pos)


def _multiset(a: DataFrame, b: DataFrame, keys: list[str], copies) -> DataFrame:
    sides = a.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(b.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = sides.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).withColumn("_n", copies("_l", "_r").cast("int")).where("_n > 0")
    return counts.select(*keys, F.explode(F.sequence(F.lit(1), "_n")).alias("_k")).drop("_k")


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Merge of two series: a value comes as often as on the side that has it more often."""
    return _multiset(a, b, keys, F.greatest)


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Values of both, each as often as on the side that has it less often."""
    return _multiset(a, b, keys, F.least)
