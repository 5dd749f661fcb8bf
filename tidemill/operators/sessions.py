"""Sessions: stretches of a key's rows without a pause longer than a gap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeaxis import micros
from ..plans.cut import table_cut
from .skew import HEAVY_SHARE, heavy_keys

COLUMNS = ["key", "start_us", "end_us", "n_events"]


def _scan(batches: Iterator[pa.RecordBatch], gap: int, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by key and start -> sessions: stretches with no pause between them are one. Between batches only the open session is kept."""
    open_: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if open_ is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b.cast(a.type)]) for a, b in zip(open_.columns, batch.columns)], COLUMNS)
        keys, start, end, n = batch.column(0).cast(key_type), *(batch.column(k).to_numpy() for k in (1, 2, 3))
        code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        # the latest end so far within the key: keys come in order, so ranks by key and end rise from key to key
        order = np.lexsort((end, code))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        latest = end[order][np.maximum.accumulate(rank)]
        at = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (start[1:] - latest[:-1] > gap))))
        last = np.append(at[1:], len(start)) - 1
        found = pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(start[at], pa.int64()), pa.array(latest[last], pa.int64()), pa.array(np.add.reduceat(n, at), pa.int64())], COLUMNS)
        open_ = found.slice(len(found) - 1)
        yield found.slice(0, len(found) - 1)
    if open_ is not None:
        yield open_


def sessions(df: DataFrame, key: str, time: str, gap_us: int, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(key, start_us, end_us, duration_us, n_events) of every session.

    A session ends where the key's next row is more than gap_us later. Rows with a
    null key or time are left out; rows of equal time and repeated rows belong to
    one session and count each. A lone row is a session of duration 0. Other
    columns of df play no part.

    Rows are sorted by key and time and scanned once, holding one open session:
    first the rows of each input partition, whose stretches are written, then the
    stretches of all partitions, partitioned by key. So a key's rows are combined
    before the shuffle, at most one stretch a gap of time and partition. The
    stretches of keys that still hold heavy_share of them or more are range-cut by
    start into parts of equal size and scanned there before.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    t = F.col("start_us")
    rows = df.select(F.col(key).alias("key"), micros(df, time).alias("start_us")).where("key is not null and start_us is not null").select("key", t, t.alias("end_us"), F.lit(1).cast("long").alias("n_events"))
    arrow = to_arrow_type(rows.schema["key"].dataType)
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *(T.StructField(c, T.LongType()) for c in COLUMNS[1:])])
    scanned = lambda part: part.sortWithinPartitions("key", "start_us").mapInArrow(lambda it: _scan(it, gap_us, arrow), schema)
    parts = table_cut(scanned(rows), "stretches")
    heavy = heavy_keys(parts.select("key"), ["key"], heavy_share).select("key")
    if not heavy.isEmpty():
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # at most 1 / heavy_share keys
        hot = scanned(parts.join(F.broadcast(heavy), "key").select(*COLUMNS).repartitionByRange(n, "key", "start_us"))
        parts = parts.join(F.broadcast(heavy), "key", "left_anti").select(*COLUMNS).unionByName(hot)
    out = scanned(parts.repartition("key"))
    return out.select(F.col("key").alias(key), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")
