"""Distinct counts and percentiles: error bounds, merging, deletions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import distinct, quantiles


def simulate(n, buckets, rng):
    h = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    bucket, rest = h % np.uint64(buckets), (h // np.uint64(buckets)) % np.uint64(1 << (distinct.LEVELS - 1))
    low = rest & (~rest + np.uint64(1))
    bits = np.zeros(buckets, np.uint64)
    np.bitwise_or.at(bits, bucket.astype(int), np.where(rest == 0, np.uint64(1 << (distinct.LEVELS - 1)), low))
    return np.array([((bits >> np.uint64(k)) & np.uint64(1)).sum() for k in range(distinct.LEVELS)], float)


@pytest.mark.parametrize("n", [10, 300, 3000, 100_000])
def test_estimates_lie_within_their_errors(n):
    rng = np.random.default_rng(n)
    counts = np.stack([simulate(n, 512, rng) for _ in range(150)])
    found, se = distinct.likelihood(counts, 512)
    z = (found - n) / np.maximum(se, 0.3)
    assert abs(z.mean()) < 0.35 and np.abs(z).max() < 5 and (se / n).mean() < 0.035
    assert 0.5 < z.std() < 1.4 or n <= 300


def test_distinct_counts(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice(["x", None]), rnd.choice([None, *range(500)])) for _ in range(6000)] + [("c", "x", 1)] * 5 + [("d", "x", None)]
    df = spark.createDataFrame(rows, "day string, country string, uid int").withColumn("bits", F.lit("theirs"))
    parts = distinct.sketch(df, ["day", "country"], "uid")
    # merged parts are the sketch of the whole, and adding rows again changes nothing
    whole = sorted(map(tuple, distinct.sketch(df, ["country"], "uid").collect()), key=repr)
    assert sorted(map(tuple, distinct.merge(parts.unionByName(parts), ["country"]).collect()), key=repr) == whole
    got = {(r.day, r.grouping, r.country): r for r in distinct.estimate(distinct.grouping_sets(parts, ["country"], ["day"]), ["day", "grouping", "country"]).collect()}
    for (day, grouping, country), r in got.items():
        want = len({u for d, c, u in rows if d == day and u is not None and (grouping == "" or c == country)})
        assert r.low - 0.5 <= want <= r.high + 0.5 and abs(r.estimate - want) <= max(1, 0.08 * want)
    assert ("d", "", None) not in got and ("a", "country", None) in got and got["c", "", None].estimate == pytest.approx(1, abs=0.01)
    assert distinct.estimate(distinct.sketch(df.where("false"), ["day"], "uid"), ["day"]).count() == 0
    with pytest.raises(ValueError):
        distinct.sketch(df, ["day"], "uid", buckets=1000)


def test_codes_keep_order_and_value():
    x = np.array([-np.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 1e-300, 1.0, 1.0 + 2**-52, 3e9, np.inf])
    codes = quantiles.encode(x)
    assert codes[4] == codes[5] and (codes[1:] > codes[:-1]).sum() == len(x) - 2 and (quantiles.decode(codes) == x).all()


def rank_error(values, p, found):
    """How far the value's ranks lie from p."""
    lo, hi = np.searchsorted(values, found) / len(values), np.searchsorted(values, found, "right") / len(values)
    return max(lo - p, p - hi, 0.0) - 1 / len(values)


def filled(x, parts=1):
    s = quantiles.Sketch()
    for part in np.array_split(x, parts):
        s.add(quantiles.encode(part), np.ones(len(part), np.int64))
    return s


@pytest.mark.parametrize("kind", ["spread", "shared", "near"])
def test_sketches_of_many_values(kind):
    rng = np.random.default_rng(3)
    x = np.round(rng.lognormal(8, 1.5, 120_000), 2)
    if kind == "shared":
        x[: len(x) // 3] = 49.99
    if kind == "near":
        x = 54321 + np.arange(len(x)) / 100
    s = filled(rng.permutation(x), 7)
    assert s.levels is not None and s.total == len(x)
    values, bound = np.sort(x), 3 * s.rank_error()
    assert 0 < bound < 0.06
    ps = (0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999)
    for p, found in zip(ps, s.quantiles(ps)):
        assert rank_error(values, p, found) <= bound


def test_the_buffer_plays_no_part(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.append(rng.normal(0, 1, 3000), [7.5] * 900)
    ps = [0.01, 0.5, 0.9]
    late = filled(x)
    monkeypatch.setattr(quantiles, "BUFFER", 10)
    soon = filled(x, 5)
    assert late.levels is None and soon.levels is not None
    again = quantiles.Sketch()
    for level, size, data in [*filled(x[:2000]).rows(), *filled(x[2000:]).rows()]:
        again.fold(level, size, data)
    for s in (soon, again):
        assert s.rank_error() == late.rank_error() and s.quantiles(ps).tolist() == late.quantiles(ps).tolist()
        assert all((a == b).all() for a, b in zip(s.levels, late.levels))


@pytest.mark.parametrize("values", [[0.1, 54321.67, 54321.68], [1.0], [float("inf"), 0.0, float("-inf"), 0.0, 1e-310]])
def test_few_values_keep_their_last_bit(values):
    s, n = filled(np.array(values)), len(values)
    assert s.quantiles([(k + 0.5) / n for k in range(n)]).tolist() == sorted(values)


def test_what_deletions_leave():
    rng = np.random.default_rng(5)
    x = rng.lognormal(8, 1, 100_000)
    s = filled(x)
    s.add(quantiles.encode(x[10:]), -np.ones(len(x) - 10, np.int64))
    assert s.total == 10 and 0 < s.rank_error() < 0.05 and rank_error(np.sort(x[:10]), 0.5, s.quantiles([0.5])[0]) <= 3 * s.rank_error()
    s.add(quantiles.encode(x[:10]), -np.ones(10, np.int64))
    assert s.total == 0 and np.isnan(s.quantiles([0.5])).all() and s.rank_error() == 0
    # an error stated for heavy values only isn't 0 either
    assert 0 < filled(np.arange(40.0).repeat(500)).rank_error() < 0.05


def test_percentiles_merge_and_delete(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", None]), rnd.gauss(50, 20), rnd.choice([1.0, 2.0, None, float("nan")])) for _ in range(30_000)]
    gone = [("a", rnd.uniform(0, 1e6), 5.0) for _ in range(10_000)]
    few = [("few", v, 3.0) for v in (5.0, 1.0, 3.0, 2.0, 4.0)] + [("none", None, None)]
    schema = "g string, x double, y double"
    df, extra = spark.createDataFrame(rows + few, schema).withColumn("level", F.lit(1)).repartition(5), spark.createDataFrame(gone, schema)
    both = quantiles.sketch(df.drop("level").unionByName(extra), ["g"], ["x", "y"])
    less = both.unionByName(quantiles.sketch(extra, ["g"], ["x", "y"], weight=-1))
    groups = {"g": df.schema["g"].dataType}
    got = {(r.g, r.column, r.p): r for r in quantiles.quantiles(less, groups, [0.0, 0.1, 0.5, 1.0]).collect()}
    for g in ("a", None):
        values = np.sort([v for k, v, _ in rows if k == g])
        for p in (0.1, 0.5):
            r = got[g, "x", p]
            assert r.n == len(values) and 0 < r.rank_error < 0.05 and rank_error(values, p, r.value) <= r.rank_error
    assert [got["few", "x", p].value for p in (0.0, 0.5, 1.0)] == [1.0, 3.0, 5.0] and 0 < got["few", "x", 0.5].rank_error < 0.05
    assert got["a", "y", 0.5].value in (1.0, 2.0) and ("none", "x", 0.5) not in got
    # the same in one step
    direct = {(r.g, r.column, r.p): r.value for r in quantiles.percentiles(df, ["g"], ["y"], [0.5]).collect()}
    assert direct["a", "y", 0.5] == got["a", "y", 0.5].value
    assert quantiles.percentiles(df.where("false"), ["g"], ["x"], [0.5]).count() == 0


def test_many_groups(spark):
    df = spark.createDataFrame([(i % 150, float(i)) for i in range(3000)], "g int, x double")
    got = {r.g: r.value for r in quantiles.percentiles(df, ["g"], ["x"], [0.5]).collect()}
    assert len(got) == 150 and all(v == pytest.approx(g + 150 * 9) for g, v in got.items())
    assert not any(math.isnan(v) for v in got.values())
