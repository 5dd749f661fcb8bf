"""Water-filling and repetitions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.llm.mixture import repetitions, water_fill


def test_water_fill():
    assert water_fill({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}) == {"a": 100, "b": 100}
    out = water_fill({"a": 1000, "b": 10, "c": 1000}, {"a": 0.4, "b": 0.2, "c": 0.4}, {"a": 2, "b": 3, "c": 2}, 1000)
    assert out == {"a": pytest.approx(485), "b": 30, "c": pytest.approx(485)}
    # a second source reaches its limit only after the first
    out = water_fill({"a": 10, "b": 25, "c": 1000}, {"a": 0.4, "b": 0.3, "c": 0.3}, {"a": 1, "b": 1, "c": 1}, 80)
    assert out == {"a": 10, "b": 25, "c": pytest.approx(45)}
    assert water_fill({"a": 10}, {"a": 1.0, "gone": 0.5}, {"a": 2, "gone": 9}, 1e9) == {"a": 20, "gone": 0.0}
    assert water_fill({}, {"a": 1.0}, {"a": 1}) == {"a": 0.0} and water_fill({"a": 5}, {"a": 0.0}, {"a": 1}) == {"a": 0.0}


def test_repetitions(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["Big ", "big"]), rnd.randrange(50, 150)) for i in range(4000)] + [(i, " small", rnd.randrange(50, 150)) for i in range(4000, 4100)]
    rows += [(9001, None, 50), (9002, "unknown", 50), (9003, "big", None), (9004, "big", 0), (None, "big", 70)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("copies", F.lit(5)).withColumn("h", F.lit(5))
    targets = spark.createDataFrame([("big", 0.7, 1), ("SMALL", 0.3, 4), ("absent", 0.0, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    docs, report = repetitions(df, targets)
    got = docs.collect()
    sizes = {s: sum(n for _, k, n in rows if k and n and k.strip().lower() == s) for s in ("big", "small")}
    by = {r.source: r for r in report.collect()}
    assert set(by) == {"big", "small", "absent", ""} and by[""].size == 100 and by["absent"].n_documents == 0
    assert max(r.copies for r in got if r.source == "small") == 4 and max(r.copies for r in got if r.source == "big") == 1
    assert by["small"].mixed_size == 4 * sizes["small"]
    total = sum(r.copies * r.n_tokens for r in got)
    assert by["big"].actual_share == pytest.approx(sum(r.copies * r.n_tokens for r in got if r.source == "big") / total)
    assert by["big"].actual_share + by["small"].actual_share == pytest.approx(1)
    assert {r.doc_id for r in got} & {9001, 9002, 9003, 9004} == set()
    again = repetitions(df, targets)[0]
    assert sorted(map(repr, got)) == sorted(map(repr, again.collect()))
    other = repetitions(df.where("source <> ' small'"), targets, total=sizes["big"] / 3)[1].where("source = 'big'").first()
    assert other.mixed_size == pytest.approx(sizes["big"] / 3, rel=0.02)


def test_small_fractions(spark):
    """A tiny fraction of a large source is met to half a document, whatever its size."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("web").alias("source"), (100 + F.col("id") % 50).alias("n_tokens"))
    targets = spark.createDataFrame([("web", 1e-4, 1), ("other", 0.9999, 1)], "source string, target_share double, max_repeats int")
    for extra in (0, 3):
        more = spark.createDataFrame([(10**6 + k, "other", 10**6) for k in range(extra)], "doc_id long, source string, n_tokens long")
        out, report = repetitions(docs.unionByName(more), targets, total=1e6)
        web = report.where("source = 'web'").first()
        wanted = 1e6 if not extra else 100.0
        assert abs(web.mixed_size - wanted) <= 75 and web.mixed_size == out.where("source = 'web'").agg(F.sum("n_tokens")).first()[0]


def test_repeated_ids_share_their_fate(spark):
    df = spark.createDataFrame([(k // 10, "a", 10) for k in range(100)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = repetitions(df, targets, total=480.0)[0].groupBy("doc_id").count().collect()
    assert len(got) == 5 and {r["count"] for r in got} == {10}


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    docs, report = repetitions(df, targets)
    assert docs.count() == 0 and report.where("source = 'big'").first().actual_share == 0
