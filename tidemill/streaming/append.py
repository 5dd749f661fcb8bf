"""Series that grow: ordered appends and averages kept as state per id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: What is known of a key so far: number and last time of its elements, sum, averages, extremes, first element, and sums and squares of the distances from it.
STATE = "n long, last long, total double, ema double, atr double, low double, high double, base double, s1 double, s2 double"
RUNNING = ["running", "ema", "atr", "low", "high", "var"]


def _advance(x: np.ndarray, state: tuple | None, n: int) -> tuple[dict[str, np.ndarray], tuple]:
    """Running results of elements that follow a state, and the state after them (without the time)."""
    count, total, ema, atr, low, high, base, s1, s2 = state or (0, 0.0, x[0], 0.0, np.inf, -np.inf, x[0], 0.0, 0.0)
    k = count + 1 + np.arange(len(x))
    smooth = lambda seed, values, alpha: pd.Series(np.append(seed, values)).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
    # the first n elements are averaged, the later ones smoothed
    young = k <= n
    ranged = np.empty(len(x))
    ranged[young] = (atr * count + np.cumsum(x[young])) / k[young]
    if not young.all():
        ranged[~young] = smooth(ranged[young][-1] if young.any() else atr, x[~young], 1.0 / n)
    d = x - base
    sums, squares = s1 + np.cumsum(d), s2 + np.cumsum(d * d)
    out = {
        "running": total + np.cumsum(x), "ema": smooth(ema, x, 2.0 / (n + 1)), "atr": ranged, "low": np.minimum(np.minimum.accumulate(x), low), "high": np.maximum(np.maximum.accumulate(x), high),
        "var": np.maximum(squares / k - (sums / k) ** 2, 0.0),
    }
    last = {c: float(v[-1]) for c, v in out.items()}
    return out, (int(k[-1]), last["running"], last["ema"], last["atr"], last["low"], last["high"], float(base), float(sums[-1]), float(squares[-1]))


def running_state(stream: DataFrame, key: str, ts: str, value: str, n: int) -> DataFrame:
    """Of a stream, every element with its position, running sum, averages (exponential of weight 2 / (n + 1), and smoothed over n), least, greatest and variance within its key, and whether it came out of order.

    Each micro-batch is sorted by time within the key. An element older than the
    last one kept is late: it gets late = true, no position (-1), not-a-number for
    the rest, and changes no state. Null keys, times and values are left out.
    """
    rows = stream.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value")).dropna()
    out = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("ts", rows.schema["ts"].dataType), *(T.StructField(c, T.DoubleType()) for c in ("value", *RUNNING)), T.StructField("pos", T.LongType()), T.StructField("late", T.BooleanType())])

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        pdf = pd.concat(list(frames)).sort_values("ts", kind="stable")
        t = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)
        late = t < known[1] if known else np.zeros(len(t), bool)
        x = pdf["value"].to_numpy(float)
        found = {c: np.full(len(x), np.nan) for c in RUNNING}
        pos = np.full(len(x), -1, np.int64)
        if not late.all():
            results, after = _advance(x[~late], (known[0], *known[2:]) if known else None, n)
            for c, v in results.items():
                found[c][~late] = v
            pos[~late] = after[0] - (~late).sum() + np.arange((~late).sum())
            state.update((after[0], int(t[~late][-1]), *after[1:]))
        yield pd.DataFrame({"key": pdf["key"].to_numpy(), "ts": pdf["ts"].to_numpy(), "value": x, **found, "pos": pos, "late": late})

    return rows.groupBy("key").applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)


def running_grid(stream: DataFrame, key: str, ts: str, value: str, step: int) -> DataFrame:
    """(key, cell, n, total, low, high) of every ``step`` elements of a key, in order of arrival and, within a micro-batch, of time. A stretch comes out when it is full; the elements of the last one wait as state."""
    rows = stream.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value")).dropna()
    out = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("cell", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("total", "low", "high"))])

    def fill(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, waiting = state.get if state.exists else (0, [])
        x = np.append(np.asarray(waiting, float), pd.concat(list(frames)).sort_values("ts", kind="stable")["value"].to_numpy(float))
        full = len(x) // step
        cells = x[: full * step].reshape(full, step)
        state.update((done + full, x[full * step :].tolist()))
        if full:
            yield pd.DataFrame({"key": [k[0]] * full, "cell": done + np.arange(full), "n": np.full(full, step), "total": cells.sum(axis=1), "low": cells.min(axis=1), "high": cells.max(axis=1)})

    return rows.groupBy("key").applyInPandasWithState(fill, out, "done long, waiting array<double>", "append", GroupStateTimeout.NoTimeout)


def append_to_store(stream: DataFrame, path: str, checkpoint: str, key: str, ts: str, value: str, n: int = 14):
    """The elements of a stream present now that came in order, as a Store of key, ts and value kept at path; what comes late is rejected. Running it again appends what is new."""
    from ..sources.store import Store

    into_table(running_state(stream, key, ts, value, n).where("not late").select(F.col("key").alias(key), F.col("ts").alias(ts), F.col("value").alias(value), "pos"), path, checkpoint)
    return Store.read(stream.sparkSession, path, ts, [key])


def windowed_totals(stream: DataFrame, key: str, ts: str, value: str, length: str, delay: str) -> DataFrame:
    """Counts and sums per key and time window.

    Appended, a window comes out once the watermark has passed it, so the last ones
    of a finite input never do; ``whole_table`` has them all.
    """
    marked = stream.withWatermark(ts, delay)
    return marked.groupBy(F.window(ts, length), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").alias("start"), "n", "total")


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All data present now, appended to a parquet table, each batch once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def whole_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The result of an aggregation over all data present now, windows still open among it, as a parquet table that each batch replaces."""
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(path)  # an empty input has no batch
    replace = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    query = stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
