"""Results per key when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.cut import table_cut

#: A key is heavy from this share of all rows on; there are at most 1 / share of them.
HEAVY_SHARE = 0.01
SALTS = 64


def heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> DataFrame:
    """The keys holding at least ``share`` of df's rows, with their ``heavy_rows``. A null is a key like any other.

    Counted in one pass over all rows, with map-side combining; no more than
    1 / share keys can be heavy, so only so many of the largest are collected,
    whatever the size of df, and the result may be broadcast. (Were the total
    counted too high, as tasks run again may do, a key would be missed, which
    makes no difference to results.)
    """
    total = Observation()
    counts = df.observe(total, F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("heavy_rows"))
    rows = counts.orderBy(F.col("heavy_rows").desc()).limit(int(1 / share) + 1).collect()
    least = max(1.0, share * total.get["n"]) if rows else 0.0
    return df.sparkSession.createDataFrame([r for r in rows if r["heavy_rows"] >= least], counts.schema)


def salted(df: DataFrame, keys: list[str], heavy: DataFrame, spread: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """df with a column ``salt``: 0 for rows of ordinary keys, one of ``salts`` values for rows of the keys of ``heavy``.

    The salt is a hash of the ``spread`` columns (of all columns and the input
    partition without them), so a task run again after a loss gives the same
    salts.
    """
    heavy = heavy.select(*[F.col(k).alias(f"_heavy_{i}") for i, k in enumerate(keys)], F.lit(True).alias("_is_heavy"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_heavy_{i}"))
    source = [F.col(c) for c in spread] if spread else [*(F.col(c) for c in df.columns), F.spark_partition_id()]
    joined = df.join(F.broadcast(heavy), on, "left")
    salt = F.when(F.col("_is_heavy"), F.pmod(F.xxhash64(*source), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    return joined.withColumn("salt", salt).select(*df.columns, "salt")


#: Aggregates that are computed per salt and then merged: name -> (partial, merge), both over a column name.
_MERGED = {
    "count": (lambda c: F.count(F.lit(1)), F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}


def salted_aggregate(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str | None]], salts: int = SALTS, share: float = HEAVY_SHARE) -> DataFrame:
    """One row per key with the named aggregates, none of whose tasks holds a heavy key alone.

    ``aggregates`` maps a result column to (kind, column): count (column None: all
    rows), sum, min, max, avg, or distinct (exact count of different values that
    aren't null). Rows of heavy keys are spread over salts, aggregated per salt,
    and the partial results are merged by the key. For distinct the salt comes
    from the value, so the sets of two salts have nothing in common and their
    sizes add up. df is read twice: for the heavy keys, and for the aggregates (once
    more for every further column whose values are counted).

    Nulls: a null key is a group; null values are skipped, and sum, min, max and
    avg of none are null. Empty input gives no rows; repeated rows count each.
    """
    plain = {k: v for k, v in aggregates.items() if v[0] != "distinct"}
    several = {k: col for k, (kind, col) in aggregates.items() if kind == "distinct"}
    heavy = heavy_keys(df.select(*keys), keys, share)
    parts, merges, final = [], [], []
    for i, (name, (kind, col)) in enumerate(plain.items()):
        if kind == "avg":
            parts += [F.sum(F.col(col).cast("double")).alias(f"_s{i}"), F.count(F.col(col)).alias(f"_n{i}")]
            merges += [F.sum(f"_s{i}").alias(f"_s{i}"), F.sum(f"_n{i}").alias(f"_n{i}")]
            final.append(F.when(F.col(f"_n{i}") > 0, F.col(f"_s{i}") / F.col(f"_n{i}")).alias(name))
            continue
        partial, merge = _MERGED[kind]
        parts.append((F.count(F.col(col)) if kind == "count" and col else partial(F.col(col) if col else None)).alias(f"_p{i}"))
        merges.append(merge(f"_p{i}").alias(f"_p{i}"))
        final.append(F.col(f"_p{i}").alias(name))
    out, used = None, list(dict.fromkeys([*keys, *(c for _, c in plain.values() if c)]))
    if not several:
        rows = salted(df.select(*used), keys, heavy, None, salts)
        return rows.groupBy(*keys, "salt").agg(*parts).groupBy(*keys).agg(*merges).select(*keys, *final)
    # the other aggregates go along with those of the first column whose values are counted
    for n, (name, col) in enumerate(several.items()):
        own, merged, shown = (parts, merges, final) if n == 0 else ([], [], [])
        rows = salted(df.select(*dict.fromkeys([*(used if n == 0 else keys), col])), keys, heavy, [col], salts)
        per_value = rows.groupBy(*keys, "salt", F.col(col).alias("_value")).agg(*(own or [F.lit(1).alias("_one")]))
        per_salt = per_value.groupBy(*keys, "salt").agg(F.count("_value").alias("_d"), *merged)
        sizes = per_salt.groupBy(*keys).agg(F.sum("_d").alias("_d"), *merged).select(*keys, F.col("_d").alias(name), *shown)
        if out is None:
            out = sizes
            continue
        right = sizes.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], name)
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_right_{i}"))
        out = out.join(right, on).drop(*[f"_right_{i}" for i in range(len(keys))])
    return out.select(*keys, *aggregates)


def unpivot_values(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per row and column of df: ``keep``, the column's name and its value as a string."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("col_value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def frequent_values(df: DataFrame, period: Column, columns: list[str], share: float) -> DataFrame:
    """(period, col_name, col_value, n_rows, share): values that more than ``share`` of a period's rows have.

    Rows with a null period are left out; null values count in the total but are
    no values. Values are taken as written.
    """
    rows = df.select(period.alias("period"), *columns).where("period is not null")
    values = unpivot_values(rows, columns, ["period"])
    # as many rows as different values; they are read for the totals and the result
    counts = table_cut(salted_aggregate(values, ["period", "col_name", "col_value"], {"n_rows": ("count", None)}), "counts")
    # each column's counts, nulls among them, add up to the period's rows
    totals = counts.groupBy("period", "col_name").agg(F.sum("n_rows").alias("n_all"))
    out = counts.where("col_value is not null").join(totals, ["period", "col_name"])
    return out.where(F.col("n_rows") > F.lit(share) * F.col("n_all")).select("period", "col_name", "col_value", "n_rows", (F.col("n_rows") / F.col("n_all")).alias("share"))
