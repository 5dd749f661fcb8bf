"""Queries of the corpus problems over the test tables, and SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cut import table_cut
from . import distinct, mixture, quality, quantiles, tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _daily_uids(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of the uids of each day, country and device; blank and null names are ''. Rows without time or valid uid are left out."""
    log = _table(spark, folder, "crashlog").where("log_time is not null and uid > 0")
    name = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("")).alias(c)
    rows = log.select("uid", F.date_format("log_time", "yyyy-MM-dd").alias("day"), name("country"), name("device"))
    return distinct.sketch(rows, ["day", "country", "device"], "uid")


def p2_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Different uids per day, country, device and every combination of the two, and the same per month from the days' sketches."""
    # days and months both build on the sketches, not on the rows
    daily = table_cut(_daily_uids(spark, folder), "uid-sketches")
    months = table_cut(distinct.merge(daily.withColumn("day", F.substring("day", 1, 7)), ["day", "country", "device"]), "uid-sketches")
    both = daily.unionByName(months).withColumnRenamed("day", "period")
    keys = ["country", "device"]
    sets = distinct.grouping_sets(both, keys, ["period"])
    return distinct.estimate(sets, ["period", "grouping", *keys])


def p2_within(spark: SparkSession, folder: str) -> DataFrame:
    """Of each grouping, the number of groups, and whether at least 0.99 of the exact counts lie within the stated bounds."""
    log = _table(spark, folder, "crashlog").where("log_time is not null and uid > 0")
    name = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("")).alias(c)
    rows = log.select("uid", F.explode(F.array(F.date_format("log_time", "yyyy-MM-dd"), F.date_format("log_time", "yyyy-MM"))).alias("period"), name("country"), name("device"))
    keys = ["country", "device"]
    sets = F.array(*[F.struct(F.lit("+".join(s)).alias("grouping"), *[F.col(k).alias(k) if k in s else F.lit(None).cast("string").alias(k) for k in keys]) for s in ([], ["country"], ["device"], keys)])
    on = ["period", "grouping", *keys]
    exact = rows.select("uid", "period", F.inline(sets)).distinct().groupBy(*on).agg(F.count("*").alias("exact"))
    found = p2_distinct(spark, folder)
    both = exact.join(found, [exact[c].eqNullSafe(found[c]) for c in on], "left").select(exact["grouping"], F.coalesce((F.col("exact") >= F.floor("low")) & (F.col("exact") <= F.ceil("high")), F.lit(False)).alias("inside"))
    return both.groupBy("grouping").agg(F.count("*").alias("n_groups"), (F.count_if("inside") >= 0.99 * F.count("*")).alias("within"))


PROBABILITIES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of price and quantity per return flag and line status, as written, of lineitems."""
    return quantiles.percentiles(_table(spark, folder, "lineitems"), ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"], PROBABILITIES)


def p4_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """The same of lineitem."""
    return quantiles.percentiles(_table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"], PROBABILITIES)


def p4_months_less_one(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of lineitem per month put together from the months, and with one month taken out again."""
    rows = _table(spark, folder, "lineitem").select("l_extendedprice", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    every = quantiles.sketch(rows, [], ["l_extendedprice"])
    gone = quantiles.sketch(rows.where("month = '1995-03'"), [], ["l_extendedprice"], weight=-1)
    whole = quantiles.quantiles(every, {}, PROBABILITIES).withColumn("part", F.lit("all"))
    less = quantiles.quantiles(every.unionByName(gone), {}, PROBABILITIES).withColumn("part", F.lit("without 1995-03"))
    return whole.unionByName(less)


def _within(rows: DataFrame, found: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, column, p, n, within): whether the exact ranks of the percentiles hold p within the stated error."""
    wanted = found.groupBy(*groups, "column").agg(F.collect_list(F.struct("p", "value", "rank_error")).alias("wanted"))
    columns = ["l_extendedprice", "l_quantity"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = rows.select(*groups, F.inline(pairs)).where("x is not null and not isnan(x)")
    # one row a group and column, of which there are few: the groups of the reports
    each = long.join(F.broadcast(wanted.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("column").alias("_column"), "wanted")), [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups] + [F.col("column") == F.col("_column")])
    counted = each.select(*groups, "column", "x", F.inline("wanted")).groupBy(*groups, "column", "p", "value", "rank_error").agg(F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto"), F.count("*").alias("n"))
    ok = (F.col("below") / F.col("n") <= F.col("p") + F.col("rank_error") + 1 / F.col("n")) & (F.col("upto") / F.col("n") >= F.col("p") - F.col("rank_error") - 1 / F.col("n"))
    return counted.select(*groups, "column", "p", "n", (ok & (F.col("rank_error") < 0.1)).alias("within"))


def p4_within(spark: SparkSession, folder: str) -> DataFrame:
    """The percentiles of lineitems against exact ranks."""
    return _within(_table(spark, folder, "lineitems"), p4_percentiles(spark, folder), ["l_returnflag", "l_linestatus"])


def p4_lineitem_within(spark: SparkSession, folder: str) -> DataFrame:
    """The percentiles of lineitem against exact ranks."""
    return _within(_table(spark, folder, "lineitem"), p4_lineitem(spark, folder), ["l_returnflag", "l_linestatus"])


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(_table(spark, folder, "documents"))


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded, decoded again and hashed; null texts have ids of their own and come back null."""
    ids = tokens.encode_corpus(_table(spark, folder, "documents"), null_ids=[-1])
    back = tokens.decode_corpus(ids, null_ids=[-1])
    return back.select("doc_id", F.md5("text").alias("text_hash"))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, folder, "documents").select(F.struct("doc_id", "source").alias("doc"), "text")
    # the counts serve the plan and the result; texts are read once
    counts = table_cut(tokens.token_counts(docs, "doc").select("doc.doc_id", "doc.source", "n_tokens"), "token-counts")
    return mixture.repetitions(counts, _table(spark, folder, "mix_targets"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the mixture and how often each is taken."""
    return _mixture(spark, folder)[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target, planned and real shares of the sources."""
    return _mixture(spark, folder)[1]


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For every source of the targets, whether it is met: its share, or all it may give, to within its largest document, and no document more often than allowed."""
    documents, report = _mixture(spark, folder)
    targets = _table(spark, folder, "mix_targets").select(mixture.canonical(F.col("source")).alias("source"), "max_repeats")
    largest = documents.groupBy("source").agg(F.max("n_tokens").alias("largest"), F.max("copies").alias("most"))
    rows = report.join(targets, "source").join(largest, "source", "left")
    planned = F.col("epochs") * F.col("size")
    met = (F.abs(F.col("mixed_size") - planned) <= F.coalesce("largest", F.lit(0))) & (F.coalesce("most", F.lit(0)) <= F.col("max_repeats"))
    # what isn't at its limit has its share of the rest
    free = (F.col("epochs") < F.col("max_repeats")) & (F.col("size") > 0) & (F.col("target_share") > 0)
    level = F.when(free, F.col("planned_share") / F.col("target_share"))
    spread = F.max(level).over(Window.partitionBy(F.lit(0))) - F.min(level).over(Window.partitionBy(F.lit(0)))
    return rows.select("source", "target_share", met.alias("met"), (F.coalesce(spread, F.lit(0.0)) < 1e-9).alias("level"), (F.abs(F.col("actual_share") - F.col("planned_share")) < 0.01).alias("near"))


def _labelled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Documents, common words and labels, or None where there is no table of labels."""
    try:
        labels = _table(spark, folder, "doc_labels")
    except AnalysisException:
        labels = None
    return _table(spark, folder, "documents"), _table(spark, folder, "common_words"), labels


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that aren't prose."""
    return quality.not_prose(*_labelled(spark, folder)).select(F.col("row_id").alias("doc_id"))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics and the outlier score of every document."""
    return quality.scored_statistics(*_labelled(spark, folder)).withColumnRenamed("row_id", "doc_id").drop("state")


def p10_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The number of cues of every document with time lines, as the statistics have it."""
    docs, words, _ = _labelled(spark, folder)
    stats = quality.text_statistics(docs, words).select(F.col("row_id").alias("doc_id"), F.col("stats")[quality.STATISTICS.index("n_cues")].cast("long").alias("n_cues"))
    return stats.join(docs.where(F.contains("text", F.lit("-->"))).select("doc_id"), "doc_id", "left_semi")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p2_distinct, p2_within, p4_percentiles, p4_lineitem, p4_months_less_one, p4_within, p4_lineitem_within, p8_ids, p8_round_trip, p9_mixture, p9_report, p9_checks, p10_found, p10_statistics, p10_plain,
    )
    return {f.__name__: f for f in named}


_WITHIN = """select l_returnflag, l_linestatus, c as "column", p, count(*) as n, true as within from (select l_returnflag, l_linestatus, unnest(['l_extendedprice', 'l_quantity']) as c, unnest([l_extendedprice, l_quantity]) as x from {table}),
    (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::double[]) as p) where x is not null and not isnan(x) group by all"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_within": """with r as (select uid, unnest([strftime(log_time, '%Y-%m-%d'), strftime(log_time, '%Y-%m')]) as period, coalesce(lower(trim(country)), '') as country, coalesce(lower(trim(device)), '') as device
            from crashlog where log_time is not null and uid > 0)
            select grouping, count(*) as n_groups, true as within from (select distinct '' as grouping, period, null as c, null as d from r union all select distinct 'country', period, country, null from r
            union all select distinct 'device', period, null, device from r union all select distinct 'country+device', period, country, device from r) group by grouping""",
        "p4_within": _WITHIN.format(table="lineitems"),
        "p4_lineitem_within": _WITHIN.format(table="lineitem"),
        "p8_round_trip": "select doc_id, md5(text) as text_hash from documents",
        "p9_checks": "select lower(trim(source)) as source, target_share, true as met, true as level, true as near from mix_targets where source is not null",
        "p10_plain": "select doc_id, len(regexp_extract_all(text, '(?m)^[^\\n]*-->')) as n_cues from documents where text like '%-->%'",
    }
