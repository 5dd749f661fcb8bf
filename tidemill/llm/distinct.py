"""Distinct counts from bit matrices: stochastic averaging over hash ranks, merged by bitwise union.

A sketch is a matrix of ``buckets`` rows and LEVELS columns of bits. An
identifier's hash picks a row, and the position of the lowest one bit of what is
left of the hash picks the column, so column k is met with probability
2 ** -(k + 1). Sketches are kept as rows (group, bucket, bits): a small group has
as many rows as different buckets, a large one ``buckets`` of them, whatever its
size, and merging days or groups is a bit_or by bucket. One group never sits in
one task before its bits are combined.

The count is the maximum of the likelihood of the column sums, all that the
likelihood depends on. Its error follows from the Fisher information: about
0.65 / sqrt(buckets) of the count for large ones.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import table_cut

BUCKETS = 2048
#: Columns of the matrix; the last one stands for all further ranks.
LEVELS = 42
SEED = 7


def sketch(df: DataFrame, keys: list[str], item: str | Column, buckets: int = BUCKETS) -> DataFrame:
    """(keys, bucket, bits) of every group. Null items are left out; a null key is a group; repeated rows change nothing."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    value = F.col(item) if isinstance(item, str) else item
    h = F.xxhash64(F.lit(SEED), value)
    rest = F.shiftrightunsigned(h, buckets.bit_length() - 1).bitwiseAND(F.lit((1 << (LEVELS - 1)) - 1))
    lowest = F.when(rest == 0, F.lit(1 << (LEVELS - 1))).otherwise(rest.bitwiseAND(-rest))
    hashed = df.where(value.isNotNull()).select(*keys, h.bitwiseAND(F.lit(buckets - 1)).cast("int").alias("bucket"), lowest.alias("bits"))
    return hashed.groupBy(*keys, "bucket").agg(F.bit_or("bits").alias("bits"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of each coarser group: the union of its parts."""
    return sketches.groupBy(*keys, "bucket").agg(F.bit_or("bits").alias("bits"))


def likelihood(counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and standard errors from column sums (one row of LEVELS sums per sketch).

    With n identifiers a bit of column k is set with probability
    1 - exp(-n q_k). The derivative of the log likelihood falls with n, so its
    zero is found by halving on a logarithmic scale. The model lets n itself vary
    as a Poisson number, which adds n to the variance; that is taken off.
    """
    k = np.arange(LEVELS)
    q = 2.0 ** -(np.minimum(k, LEVELS - 2) + 1.0) / buckets
    low, high = np.full(len(counts), np.log(0.1)), np.full(len(counts), np.log(1e17))
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for _ in range(90):
            mid = (low + high) / 2
            x = np.exp(mid)[:, None] * q
            slope = (q * (counts / np.expm1(x) - (buckets - counts))).sum(axis=1)
            low, high = np.where(slope > 0, mid, low), np.where(slope > 0, high, mid)
        n = np.exp((low + high) / 2)
        n[counts.sum(axis=1) == 0] = 0.0
        information = buckets * (q**2 / np.expm1(np.maximum(n, 1e-9)[:, None] * q)).sum(axis=1)
        variance = np.where(n > 0, np.maximum(1.0 / information - n, 0.0), 0.0)
    return n, np.sqrt(variance)


def estimate(sketches: DataFrame, keys: list[str], buckets: int = BUCKETS, sigmas: float = 3.0) -> DataFrame:
    """(keys, estimate, std_error, low, high): the count of each group and its bounds at ``sigmas`` standard errors.

    A count is never below the number of buckets that were met.
    """
    sums = [F.sum(F.shiftright("bits", k).bitwiseAND(F.lit(1).cast("long"))).alias(f"c{k}") for k in range(LEVELS)]
    by_group = sketches.groupBy(*keys).agg(F.count(F.lit(1)).alias("met"), *sums).select(*keys, "met", F.array(*[f"c{k}" for k in range(LEVELS)]).alias("c"))

    @F.pandas_udf("estimate double, std_error double")
    def solve(c: pd.Series) -> pd.DataFrame:
        table = np.array(c.tolist(), float).reshape(-1, LEVELS)
        n, se = likelihood(table, buckets)
        return pd.DataFrame({"estimate": n, "std_error": se})

    out = by_group.withColumn("e", solve("c"))
    n = F.greatest(F.col("e.estimate"), F.col("met").cast("double"))
    wide = F.lit(sigmas) * F.col("e.std_error")
    return out.select(*keys, n.alias("estimate"), F.col("e.std_error").alias("std_error"), F.greatest(n - wide, F.col("met").cast("double")).alias("low"), (n + wide).alias("high"))


def grouping_sets(sketches: DataFrame, keys: list[str], always: list[str]) -> DataFrame:
    """The sketches of every combination of ``keys`` within ``always``, as (always, grouping, keys, bucket, bits).

    ``grouping`` names the keys that take part, joined by '+' ('' for none); the
    others are null in its rows. ``sketches`` has one row per group and bucket, as
    sketch and merge give them. Every combination is merged from one with a key
    more, the combinations of equal size in one pass, so the rows that are merged
    get fewer from step to step.
    """
    kinds = {k: sketches.schema[k].dataType for k in keys}
    name = lambda s: "+".join(k for k in keys if k in s)
    level = sketches.select(*always, F.lit(name(keys)).alias("grouping"), *keys, "bucket", "bits")
    out = level
    for size in range(len(keys) - 1, -1, -1):
        forms = []
        for s in itertools.combinations(keys, size):
            # the combination with the first key that s lacks
            parent = name([*s, next(k for k in keys if k not in s)])
            form = F.struct(F.lit(name(s)).alias("grouping"), *[(F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys])
            forms.append(F.when(F.col("grouping") == parent, form))
        level = table_cut(merge(level.select(*always, "bucket", "bits", F.inline(F.array_compact(F.array(*forms)))), [*always, "grouping", *keys]), "sketches")
        out = out.unionByName(level)
    return out
