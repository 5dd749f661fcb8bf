"""Long series in chunks: operators of order for series too long for one task.

The rows are range-partitioned by ids and order into chunks and written with
their chunk number, so a long series (the only one, or one with a third of all
rows) is several pieces, each sorted and scanned alone. What a piece needs of
those before it (a row count, a last row, a running total, a carried average)
comes from one row per piece. Only pieces that continue a series need it; every
border between chunks cuts one series at most, so there are fewer of them than
chunks, which is why they are broadcast.

Positions, changes, runs, trends and averages are scanned as the chunks are
written, without another shuffle; running aggregates and windows are windows on
the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cut import table_cut


def _ranged(df: DataFrame, order: list[str], ids, chunks: int | None) -> DataFrame:
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in (*ids, *order)])


def chunked(df: DataFrame, order: list[str], ids: list[str] | tuple[str, ...] = (), chunks: int | None = None) -> DataFrame:
    """df with a column ``chunk``: all rows of a chunk come before all rows of the next, by ids and then order. ``order`` should be total: rows equal in it stay in one chunk."""
    return table_cut(_ranged(df, order, ids, chunks).withColumn("chunk", F.spark_partition_id()), "chunks")


def _same_as_before(batch: pa.RecordBatch, at: list[int]) -> np.ndarray:
    """Whether a row has the same values as the one before in the columns at these places; nulls are equal."""
    out = np.ones(max(batch.num_rows - 1, 0), bool)
    for k in at:
        c = batch.column(k)
        x, y = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        both = pc.and_(pc.is_null(x), pc.is_null(y))
        if pa.types.is_floating(c.type):
            both = pc.or_(both, pc.fill_null(pc.and_(pc.is_nan(x), pc.is_nan(y)), False))
        out &= np.asarray(pc.if_else(pc.fill_null(pc.equal(x, y), False), True, both))
    return out


def _trace(batches: Iterator[pa.RecordBatch], n_ids: int, value: int | None) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their place in their piece, the value before, and whether they are the last of the piece. One row is held back between batches."""
    held, place = None, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(held.columns, batch.columns)], schema=batch.schema)
        goes_on = np.concatenate(([held is not None and place >= 0], _same_as_before(batch, list(range(n_ids)))))
        # the held row has its place already
        start = np.where(goes_on, 0, np.arange(len(goes_on)))
        start[0] = 0
        first = np.maximum.accumulate(start)
        at = np.arange(len(goes_on)) - first + np.where(first == 0, max(place, 0), 0)
        last = np.append(~goes_on[1:], True)
        extra = [pa.array(at, pa.int64()), pa.array(last)]
        if value is not None:
            c = batch.column(value)
            before = pa.concat_arrays([pa.nulls(1, c.type), c.slice(0, len(c) - 1)])
            extra.append(before)
        out = pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *["_k", "_last", "_prev"][: len(extra)]])
        if held is not None and value is not None:
            # what was before the held row was found with the batch it came in
            fixed = pa.concat_arrays([held_before, out.column(out.num_columns - 1).slice(1)])
            out = out.set_column(out.num_columns - 1, "_prev", fixed)
        yield out.slice(0, len(out) - 1)
        held, place = batch.slice(batch.num_rows - 1), int(at[-1])
        held_before = out.column(out.num_columns - 1).slice(len(out) - 1) if value is not None else None
    if held is not None:
        extra = [pa.array([place], pa.int64()), pa.array([True]), *([held_before] if value is not None else [])]
        yield pa.RecordBatch.from_arrays([*held.columns, *extra], [*held.schema.names, *["_k", "_last", "_prev"][: len(extra)]])


def traced(df: DataFrame, order: list[str], ids: list[str] | tuple[str, ...] = (), value: str | None = None, chunks: int | None = None) -> DataFrame:
    """df in chunks, with ``chunk``, ``_k`` (the row's place in its piece, from 0), ``_last`` (the last row of its piece) and ``_prev`` (value of the row before in the piece)."""
    names = [*ids, *[c for c in df.columns if c not in ids]]
    placed = _ranged(df.select(*names), order, ids, chunks).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*ids, *order)])
    fields = [*placed.schema.fields, T.StructField("_k", T.LongType()), T.StructField("_last", T.BooleanType())]
    if value is not None:
        fields.append(T.StructField("_prev", df.schema[value].dataType))
    at = names.index(value) if value is not None else None
    scanned = placed.mapInArrow(lambda it: _trace(it, len(ids), at), T.StructType(fields))
    return table_cut(scanned.withColumn("chunk", F.spark_partition_id()), "chunks")


def _piece(ids, order: list[str]):
    return Window.partitionBy(*ids, "chunk").orderBy(*[F.col(c).asc_nulls_first() for c in order])


def _linked(rows: DataFrame, ids, named: DataFrame, how: str = "left") -> DataFrame:
    """rows with the columns of named (ids and chunk as _id0.. and _chunk) of their piece."""
    on = F.col("chunk") == F.col("_chunk")
    for k, c in enumerate(ids):
        on = on & F.col(c).eqNullSafe(F.col(f"_id{k}"))
    return rows.join(F.broadcast(named), on, how).drop("_chunk", *[f"_id{k}" for k in range(len(ids))])


def _with_ends(rows: DataFrame, ids, carried: dict[str, Column]) -> DataFrame:
    """rows with columns computed over the last rows of the series' pieces (``_earlier``); null in a series' first piece."""
    ends = rows.where("_last")
    by_series = Window.partitionBy(*(ids or [F.lit(0)])).orderBy("chunk")
    pieces = ends.withColumn("_before", F.count(F.lit(1)).over(by_series.rowsBetween(Window.unboundedPreceding, -1)))
    pieces = pieces.withColumns(carried).where("_before > 0")
    named = pieces.select(*[F.col(c).alias(f"_id{k}") for k, c in enumerate(ids)], F.col("chunk").alias("_chunk"), *carried)
    return _linked(rows, ids, named)


def _earlier(ids):
    """Window over the pieces of a series before one, and the piece before it."""
    by_series = Window.partitionBy(*(ids or [F.lit(0)])).orderBy("chunk")
    return by_series.rowsBetween(Window.unboundedPreceding, -1), by_series


def _with_carried(rows: DataFrame, ids, measure: Column, carry: Column, name: str) -> DataFrame:
    """rows with ``name``: ``carry`` (an aggregate of m) over the measures m of the series' pieces before; null in its first piece."""
    parts = rows.groupBy(*ids, "chunk").agg(measure.alias("m"))
    before = Window.partitionBy(*(ids or [F.lit(0)])).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    pieces = parts.withColumn("_before", F.count(F.lit(1)).over(before)).withColumn("_carry", carry.over(before)).where("_before > 0")
    named = pieces.select(*[F.col(c).alias(f"_id{k}") for k, c in enumerate(ids)], F.col("chunk").alias("_chunk"), F.col("_carry").alias(name))
    return _linked(rows, ids, named)


def positions(df: DataFrame, order: list[str], name: str = "pos", ids: list[str] | tuple[str, ...] = (), chunks: int | None = None) -> DataFrame:
    """df with 0-based positions within ids in the given order."""
    before, _ = _earlier(ids)
    rows = _with_ends(traced(df, order, ids, None, chunks), ids, {"_base": F.sum(F.col("_k") + 1).over(before)})
    placed = rows.withColumn("_pos", F.coalesce("_base", F.lit(0)) + F.col("_k"))
    return placed.select(*[c for c in df.columns if c != name], F.col("_pos").alias(name))


def _with_before(df: DataFrame, order: list[str], ids, value: str, chunks: int | None) -> DataFrame:
    """df with chunk, _k, _last and ``_b``: a struct (v) of the value of the row before, null for the first row of a series."""
    _, by_series = _earlier(ids)
    rows = _with_ends(traced(df, order, ids, value, chunks), ids, {"_base": F.lag(F.struct(F.col(value).alias("v"))).over(by_series)})
    return rows.withColumn("_b", F.when(F.col("_k") > 0, F.struct(F.col("_prev").alias("v"))).otherwise(F.col("_base"))).drop("_prev", "_base")


def changes(df: DataFrame, order: list[str], value: str, name: str = "change", ids: list[str] | tuple[str, ...] = (), chunks: int | None = None) -> DataFrame:
    """df with value minus the value of the row before; 0 for the first row."""
    rows = _with_before(df, order, ids, value, chunks)
    return rows.select(*[c for c in df.columns if c != name], F.when(F.col("_b").isNull(), F.lit(0)).otherwise(F.col(value) - F.col("_b.v")).alias(name))


def unique(df: DataFrame, order: list[str], value: str, ids: list[str] | tuple[str, ...] = (), chunks: int | None = None) -> DataFrame:
    """df without the rows whose value is that of the row before; a null is equal to a null."""
    rows = _with_before(df, order, ids, value, chunks)
    return rows.where(F.col("_b").isNull() | ~F.col("_b.v").eqNullSafe(F.col(value))).select(*df.columns)


def runs(df: DataFrame, order: list[str], key: str, name: str = "run_id", ids: list[str] | tuple[str, ...] = (), chunks: int | None = None) -> DataFrame:
    """df with the number of the run of equal keys, from 0 within ids; a null is equal to a null."""
    marked = _with_before(df, order, ids, key, chunks).withColumn("_new", (F.col("_b").isNull() | ~F.col("_b.v").eqNullSafe(F.col(key))).cast("long"))
    # the chunks are kept: the rows stay in the pieces they are in
    numbered = _with_carried(marked, ids, F.sum("_new"), F.sum("m"), "_runs")
    within = F.sum("_new").over(Window.partitionBy(*ids, "chunk").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("_run", within + F.coalesce("_runs", F.lit(0)) - 1).select(*[c for c in df.columns if c != name], F.col("_run").alias(name))


def trend(df: DataFrame, order: list[str], value: str, name: str = "trend", ids: list[str] | tuple[str, ...] = (), chunks: int | None = None) -> DataFrame:
    """df with the sign of the last change; a plateau keeps the trend before it; 0 up to the first change."""
    sign = F.signum(F.col(value) - F.col("_b.v"))
    signed = _with_before(df, order, ids, value, chunks).withColumn("_s", F.when(sign != 0, sign.cast("int")))
    last = F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_k")))
    carried = _with_carried(signed, ids, last, F.last("m", ignorenulls=True), "_trend")
    within = F.last("_s", ignorenulls=True).over(Window.partitionBy(*ids, "chunk").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return carried.withColumn("_t", F.coalesce(within, "_trend", F.lit(0))).select(*[c for c in df.columns if c != name], F.col("_t").alias(name))


def ranks(df: DataFrame, value: str, name: str = "rank", descending: bool = False, dense: bool = False, ids: list[str] | tuple[str, ...] = (), chunks: int | None = None) -> DataFrame:
    """df with 1-based ranks by value within ids; equal values share the lowest. The different values with their counts are ranked, and the ranks go back by value."""
    counts = df.groupBy(*ids, value).agg(F.count(F.lit(1)).alias("_n"))
    key = counts.withColumn("_o", -F.col(value) if descending else F.col(value))
    ranked = running(key, ["_o"], "_n", "count" if dense else "sum", "_upto", ids, chunks)
    rank = F.col("_upto") if dense else F.col("_upto") - F.col("_n") + 1
    named = ranked.select(*[F.col(c).alias(f"_id{k}") for k, c in enumerate(ids)], F.col(value).alias("_value"), rank.alias(name))
    on = F.col(value).eqNullSafe(F.col("_value"))
    for k, c in enumerate(ids):
        on = on & F.col(c).eqNullSafe(F.col(f"_id{k}"))
    return df.drop(name).join(named, on).drop("_value", *[f"_id{k}" for k in range(len(ids))])


def sort(df: DataFrame, value: str, pos: str, descending: bool = False, ids: list[str] | tuple[str, ...] = (), chunks: int | None = None) -> DataFrame:
    """df in order of value, equal ones in order of pos: pos anew, the old one as from_pos."""
    moved = df.withColumn("from_pos", F.col(pos)).withColumn("_o", -F.col(value) if descending else F.col(value))
    return positions(moved.drop(pos), ["_o", "from_pos"], pos, ids, chunks).drop("_o")


def quantiles(df: DataFrame, value: str, q: int, ids: list[str] | tuple[str, ...] = (), chunks: int | None = None) -> DataFrame:
    """(ids, part, v): of the sorted values those at count * i div q for i < q, and the greatest, found in the counts of the different values."""
    counts = df.groupBy(*ids, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = table_cut(running(counts, [value], "_n", "sum", "_upto", ids, chunks), "ranks")
    sizes = upto.groupBy(*ids).agg(F.sum("_n").alias("_all")) if ids else upto.agg(F.sum("_n").alias("_all"))
    places = F.array(*[F.struct(F.lit(i).alias("part"), (F.call_function("div", F.col("_all") * i, F.lit(q)) if i < q else F.col("_all") - 1).alias("k")) for i in range(q + 1)])
    # q + 1 rows a series; a value answers the places among its ranks
    if ids:
        named = sizes.select(*[F.col(c).alias(f"_id{k}") for k, c in enumerate(ids)], "_all")
        on = [F.col(c).eqNullSafe(F.col(f"_id{k}")) for k, c in enumerate(ids)]
        both = upto.join(named, on).withColumn("_p", F.filter(places, lambda x: (x["k"] < F.col("_upto")) & (x["k"] >= F.col("_upto") - F.col("_n"))))
    else:
        n = sizes.first()[0]
        both = upto.withColumn("_all", F.lit(n)).withColumn("_p", F.filter(places, lambda x: (x["k"] < F.col("_upto")) & (x["k"] >= F.col("_upto") - F.col("_n"))))
    return both.select(*ids, F.col(value).alias("v"), F.explode("_p").alias("_x")).select(*ids, "_x.part", "v")


def running(df: DataFrame, order: list[str], value: str, kind: str = "sum", name: str = "running", ids: list[str] | tuple[str, ...] = (), chunks: int | None = None) -> DataFrame:
    """df with the running sum, count, min, max, prd, avg, var or dev of value within ids."""
    if kind in ("avg", "var", "dev"):
        return _running_moments(df, order, value, kind, name, ids, chunks)
    inner = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "prd": F.product}[kind]
    outer = F.sum if kind == "count" else inner
    rows = _with_carried(chunked(df, order, ids, chunks), ids, inner(value), outer("m"), "_base")
    own = rows.withColumn("_v", inner(value).over(_piece(ids, order).rowsBetween(Window.unboundedPreceding, 0)))
    if kind in ("sum", "count"):
        both = F.when(F.col("_base").isNull(), F.col("_v")).otherwise(F.coalesce("_v", F.lit(0)) + F.col("_base"))
    elif kind == "prd":
        both = F.when(F.col("_base").isNull(), F.col("_v")).otherwise(F.coalesce("_v", F.lit(1.0)) * F.col("_base"))
    else:
        both = F.least("_v", "_base") if kind == "min" else F.greatest("_v", "_base")
    return own.withColumn(name, both).drop("chunk", "_v", "_base")


def _running_moments(df: DataFrame, order: list[str], value: str, kind: str, name: str, ids, chunks: int | None) -> DataFrame:
    """Running average, variance or deviation: counts, means and squared distances of the pieces before, added to those within the piece."""
    rows, before = chunked(df, order, ids, chunks), Window.partitionBy(*(ids or [F.lit(0)])).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    x = F.col(value).cast("double")
    parts = rows.groupBy(*ids, "chunk").agg(F.count(value).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(value)).alias("s"))
    m, n = F.coalesce("m", F.lit(0.0)), F.col("n")
    joint = parts.withColumn("_n0", F.sum(n).over(before)).withColumn("_m0", F.sum(n * m).over(before) / F.nullif(F.col("_n0"), F.lit(0)))
    # around the mean of all pieces before: theirs within, and theirs between
    joint = joint.withColumn("_all", F.collect_list(F.struct(n.alias("n"), m.alias("m"), F.coalesce("s", F.lit(0.0)).alias("s"))).over(before)).where("_n0 is not null")
    spread = F.aggregate("_all", F.lit(0.0), lambda acc, p: acc + p["s"] + p["n"] * (p["m"] - F.col("_m0")) * (p["m"] - F.col("_m0")))
    named = joint.select(*[F.col(c).alias(f"_id{k}") for k, c in enumerate(ids)], F.col("chunk").alias("_chunk"), "_n0", F.coalesce("_m0", F.lit(0.0)).alias("_m0"), F.coalesce(spread, F.lit(0.0)).alias("_s0"))
    upto = _piece(ids, order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({"_n": F.count(value).over(upto), "_m": F.coalesce(F.avg(x).over(upto), F.lit(0.0)), "_s": F.coalesce(F.var_pop(x).over(upto), F.lit(0.0))})
    both = _linked(own, ids, named).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("_n0", "_m0", "_s0")})
    size = F.col("_n0") + F.col("_n")
    gap = F.col("_m") - F.col("_m0")
    mean = F.col("_m0") + gap * F.col("_n") / size
    var = (F.col("_s0") + F.col("_s") * F.col("_n") + gap * gap * F.col("_n0") * F.col("_n") / size) / size
    out = F.when(size > 0, mean if kind == "avg" else var if kind == "var" else F.sqrt(var))
    return both.withColumn(name, out).drop("chunk", "_n", "_m", "_s", "_n0", "_m0", "_s0")


def moving_average(df: DataFrame, order: list[str], value: str, n: int, name: str = "ema", ids: list[str] | tuple[str, ...] = (), chunks: int | None = None, alpha: float | None = None) -> DataFrame:
    """df with the exponential moving average of weight 2 / (n + 1), or alpha, within ids, seeded with the first value. value has no nulls.

    A piece is scanned as if its series began there. Had it begun with another
    average, every result would differ by a power of the kept share times the
    difference, so a piece that continues a series is corrected by one figure.
    The figures follow from one another through the pieces of a series; there are
    at most two pieces per chunk in series that have several.
    """
    from ..operators.recursive import scan_sorted

    keep = 1 - (2.0 / (n + 1) if alpha is None else alpha)
    names = [*ids, *[c for c in df.columns if c not in ids]]
    placed = _ranged(df.select(*names), order, ids, chunks).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*ids, *order)])
    fields = [*placed.schema.fields, T.StructField("_k", T.LongType()), T.StructField("_last", T.BooleanType())]
    placed = placed.mapInArrow(lambda it: _trace(it, len(ids), None), T.StructType(fields))
    scanned = table_cut(scan_sorted(placed, list(ids), value, 1 - keep, "_own").withColumn("chunk", F.spark_partition_id()), "averages")
    out_names = [f"_id{k}" for k in range(len(ids))]
    first = scanned.where("_k = 0").select(*ids, "chunk", F.col(value).alias("first"))
    ends = scanned.where("_last").withColumn("_pieces", F.count(F.lit(1)).over(Window.partitionBy(*(ids or [F.lit(0)])))).where("_pieces > 1")
    on = [ends[c].eqNullSafe(first[c]) for c in (*ids, "chunk")]
    several = ends.join(first, on).select(*[ends[c] for c in ids], ends["chunk"], F.col("_own").alias("own"), (F.col("_k") + 1).alias("n"), "first").orderBy(*ids, "chunk").collect()
    shift, at, series = [], 0.0, None
    for row in several:
        key = tuple(row[c] for c in ids)
        if key != series:
            series, at = key, row["own"]
            continue
        delta = at - row["first"]
        shift.append((*key, row["chunk"], float(delta)))
        at = row["own"] + keep ** row["n"] * delta
    schema = ", ".join([*(f"{a} {df.schema[c].dataType.simpleString()}" for a, c in zip(out_names, ids)), "_chunk int", "_delta double"])
    out = _linked(scanned, ids, df.sparkSession.createDataFrame(shift, schema))
    return out.withColumn(name, F.col("_own") + F.pow(F.lit(keep), F.col("_k") + 1) * F.coalesce("_delta", F.lit(0.0))).select(*[c for c in df.columns if c != name], name)


def smoothed_range(df: DataFrame, order: list[str], value: str, n: int, name: str = "atr", ids: list[str] | tuple[str, ...] = (), chunks: int | None = None) -> DataFrame:
    """df with the running mean over the first n values, then acc * (n - 1) / n + v / n, within ids. value has no nulls.

    The first n rows of a series are a window of their own; from the n-th row on
    it is an exponential average of weight 1 / n seeded with their mean.
    """
    rows = table_cut(positions(df, order, "_p", ids, chunks), "positions")
    young = rows.where(F.col("_p") < n).withColumn("_v", F.avg(F.col(value).cast("double")).over(Window.partitionBy(*ids).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    old = young.where(F.col("_p") == n - 1).unionByName(rows.where(F.col("_p") >= n).withColumn("_v", F.col(value).cast("double")))
    smooth = moving_average(old, ["_p"], "_v", n, "_a", ids, chunks, alpha=1.0 / n).where(F.col("_p") >= n)
    both = young.withColumn("_a", F.col("_v")).unionByName(smooth.select(*young.columns, "_a"))
    return both.select(*[c for c in df.columns if c != name], F.col("_a").alias(name))


def pieces(df: DataFrame, order: list[str], reach: int, ids: list[str] | tuple[str, ...] = (), chunks: int | None = None):
    """The pieces of long series as series of their own, each led by the ``reach`` rows before it.

    Those rows have ``halo`` true and are to be dropped after the computation.
    Whatever looks back at most reach rows (moving windows of reach + 1 elements,
    changes) has the same result on a piece as on the whole series, the first
    reach elements of a series included. Chunks must hold at least reach rows;
    fewer are an error.
    """
    from ..frame import Series

    rows = chunked(df, order, ids, chunks).withColumn("halo", F.lit(False))
    by_series = Window.partitionBy(*(ids or [F.lit(0)]))
    parts = rows.groupBy(*ids, "chunk").agg(F.count(F.lit(1)).alias("_n"))
    linked = parts.withColumn("_next", F.lead("chunk").over(by_series.orderBy("chunk"))).withColumn("_first", F.min("chunk").over(by_series)).where("_next is not null")
    short = (F.col("_n") < reach) & (F.col("chunk") != F.col("_first"))
    linked = linked.withColumn("_next", F.when(short, F.raise_error(F.lit("a chunk holds fewer rows than the reach")).cast("int")).otherwise(F.col("_next")))
    named = linked.select(*[F.col(c).alias(f"_id{k}") for k, c in enumerate(ids)], F.col("chunk").alias("_chunk"), "_next")
    back = Window.partitionBy(*ids, "chunk").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    # pieces that go on: fewer than chunks
    ends = _linked(rows, ids, named, "inner").withColumn("_k", F.row_number().over(back)).where(F.col("_k") <= reach)
    lead = ends.withColumn("chunk", F.col("_next")).withColumn("halo", F.lit(True)).select(*rows.columns)
    return Series.of(rows.unionByName(lead), order, [*ids, "chunk"], "piece_pos")
