"""Percentiles of very large columns from dyadic Count-sketches.

A value becomes an ordered whole number of BITS bits, the bits of its double, so
values lose nothing. For every binary resolution a sketch holds signed counts of
the intervals at that resolution; resolutions with fewer intervals than a sketch
has cells are counted exactly. Sketches add up, and rows with negative weight
take earlier ones out again. A percentile is found by walking down from the
interval that holds everything, going left or right by the estimated count of
the left half.

A sketch is a linear function of its values and their counts. Up to BUFFER
different values that were not yet added to the cells are kept as they are, in
memory and in the stored rows; when a percentile is read they are added, so the
result is that of the cells whatever BUFFER is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 64
DEPTH = 5
WIDTH = 2048
#: Different values that wait until they are added to the cells at once.
BUFFER = 1 << 15
#: Sketches that one task holds at a time; beyond, it passes on what it has and starts anew.
HELD = 32
#: Standard deviation of the median of five, in those of one.
MEDIAN_OF_FIVE = 0.5355
#: Numbers of largest cells that may be taken as heavy values when the error is estimated.
HEAVY_CELLS = [0, 1, 2, 4, 8, 16, 32, 64]
WAITING = -1  # the level under which values that wait are stored, with their counts


def encode(x: np.ndarray) -> np.ndarray:
    """Order-preserving codes (unsigned) of doubles that aren't NaN."""
    bits = (x + 0.0).view(np.int64)  # -0.0 becomes 0.0
    return np.where(bits < 0, ~bits, bits | np.int64(-(2**63))).view(np.uint64)


def decode(codes: np.ndarray) -> np.ndarray:
    """The values of codes."""
    codes = codes.astype(np.uint64)
    return np.where((codes >> np.uint64(63)) == 0, ~codes, codes & np.uint64(2**63 - 1)).view(np.float64)


def sketched(level: int) -> bool:
    """Whether a level has more intervals than a sketch has cells; others are counted exactly."""
    return (1 << (BITS - level)) > DEPTH * WIDTH


def _mixed(nodes: np.ndarray, level: int) -> np.ndarray:
    """64 bits for each node, of which every row takes its own: a public mixing function (fixed values) seeded by the level."""
    with np.errstate(over="ignore"):
        z = nodes + np.uint64(((level + 1) * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _place(mixed: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign in a row."""
    own = (mixed >> np.uint64(12 * row)).astype(np.int64)
    return own & (WIDTH - 1), 1 - ((own >> 10) & 2)


def _size(level: int) -> int:
    return DEPTH * WIDTH if sketched(level) else 1 << (BITS - level)


def _nodes(codes: np.ndarray, level: int) -> np.ndarray:
    return codes >> np.uint64(level) if level < 64 else np.zeros(len(codes), np.uint64)


def level_cells(codes: np.ndarray, counts: np.ndarray, level: int) -> np.ndarray:
    """The cells of one level from codes in order and their counts."""
    nodes = _nodes(codes, level)
    if not sketched(level):
        return np.bincount(nodes.astype(np.int64), weights=counts, minlength=_size(level)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
    mixed, sums = _mixed(nodes[starts], level), np.add.reduceat(counts, starts)
    out = np.empty(DEPTH * WIDTH, np.int64)
    for row in range(DEPTH):
        cell, sign = _place(mixed, row)
        out[row * WIDTH : (row + 1) * WIDTH] = np.bincount(cell, weights=sign * sums, minlength=WIDTH)
    return out


def _combine(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order with the sums of their counts, but those of sum 0."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    sums = np.add.reduceat(counts, starts)
    return codes[starts][sums != 0], sums[sums != 0]


def _pack(a: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(a.astype("<i8").tobytes(), asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, n * 8, asbytes=True), "<i8").copy()


class Sketch:
    """One array of cells a level, and the values that wait to be added to them."""

    def __init__(self) -> None:
        self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.levels: list[np.ndarray] | None = None  # None: no cell is set

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes, self.counts = _combine(np.concatenate((self.codes, codes)), np.concatenate((self.counts, counts)))
        if len(self.codes) > BUFFER:
            self.settle()

    def settle(self) -> None:
        """Add what waits to the cells."""
        if self.levels is None:
            self.levels = [np.zeros(_size(level), np.int64) for level in range(BITS + 1)]
        if len(self.codes):
            for level, cells in enumerate(self.levels):
                cells += level_cells(self.codes, self.counts, level)
            self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """(level, size, data) rows."""
        if len(self.codes) or self.levels is None:
            yield WAITING, 2 * len(self.codes), _pack(np.concatenate((self.codes.view(np.int64), self.counts)))
        for level, cells in enumerate(self.levels or []):
            yield level, len(cells), _pack(cells)

    def fold(self, level: int, size: int, data: bytes) -> None:
        """Add one stored row."""
        cells = _unpack(data, size)
        if level == WAITING:
            self.add(cells[: size // 2].view(np.uint64), cells[size // 2 :])
            return
        if self.levels is None:
            self.levels = [np.zeros(_size(k), np.int64) for k in range(BITS + 1)]
        self.levels[level] += cells

    @property
    def total(self) -> int:
        return int(self.counts.sum()) + (0 if self.levels is None else int(self.levels[BITS][0]))

    def count(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Estimated counts of intervals of one level."""
        cells = self.levels[level]
        if not sketched(level):
            return cells[nodes.astype(np.int64)].astype(float)
        mixed, found = _mixed(nodes, level), np.empty((DEPTH, len(nodes)))
        for row in range(DEPTH):
            cell, sign = _place(mixed, row)
            found[row] = sign * cells[row * WIDTH + cell]
        return np.median(found, axis=0)

    def rank_error(self) -> float:
        """Standard error of a rank as a share of all rows.

        The errors of the levels add up as variances. An estimate is the median of
        DEPTH rows, each off by what else fell into its cell. If k values are taken
        as heavy, the rest gives the variance of such a median, and the heavy ones
        spoil it where three rows meet one of them, whose probability is about
        10 (k / WIDTH) ** 3. Any k gives a valid estimate; the least is taken.
        """
        self.settle()
        if self.total <= 0:
            return 0.0
        variance = 0.0
        for level, cells in enumerate(self.levels):
            if sketched(level):
                squares = -np.sort(-(cells.reshape(DEPTH, WIDTH).astype(float) ** 2), axis=1)
                sums = np.concatenate((np.zeros((DEPTH, 1)), np.cumsum(squares, axis=1)), axis=1)
                variance += min(
                    float(np.median(sums[:, -1] - sums[:, k])) / (WIDTH - k) * MEDIAN_OF_FIVE**2 + 10 * (k / WIDTH) ** 3 * float(np.median(sums[:, k])) / max(k, 1) for k in HEAVY_CELLS
                )
        return variance**0.5 / self.total

    def quantiles(self, probabilities: list[float]) -> np.ndarray:
        """Values of rank ceil(p * n), at least 1; NaN if nothing is left."""
        n = self.total
        if n <= 0:
            return np.full(len(probabilities), np.nan)
        self.settle()
        left = np.maximum(1.0, np.ceil(np.asarray(probabilities, float) * n))
        nodes, inside = np.zeros(len(left), np.uint64), np.full(len(left), float(n))
        for level in range(BITS - 1, -1, -1):
            nodes = nodes << np.uint64(1)
            first = np.clip(self.count(level, nodes), 0.0, inside)
            right = left > first
            nodes = nodes + right.astype(np.uint64)
            inside, left = np.where(right, inside - first, first), np.where(right, left - first, left)
        return decode(nodes)


SCHEMA = "group_id string, column string, part int, level int, size int, data binary"


def _rows(held: dict[tuple[str, str], Sketch], part: int) -> Iterator[pa.RecordBatch]:
    for (group, column), s in held.items():
        found = list(s.rows())
        n = len(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([group] * n, pa.string()), pa.array([column] * n, pa.string()), pa.array([part] * n, pa.int32()),
                pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.int32()), pa.array([r[2] for r in found], pa.binary()),
            ],
            ["group_id", "column", "part", "level", "size", "data"],
        )
    held.clear()


def _build(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """(group_id, weight, columns...) -> the rows of this task's sketches."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: dict[tuple[str, str], Sketch] = {}
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        code, groups = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        weight = batch.column(1).to_numpy(zero_copy_only=False)
        for k, column in enumerate(columns):
            x = np.asarray(batch.column(2 + k).to_numpy(zero_copy_only=False), float)
            ok = np.flatnonzero(~np.isnan(x))
            order = ok[np.argsort(code[ok], kind="stable")]
            values, weights = encode(x[order]), weight[order]
            ends = np.searchsorted(code[order], np.arange(len(groups)), side="right")
            for group, a, b in zip(groups, np.append(0, ends[:-1]), ends):
                if b > a:
                    held.setdefault((group, column), Sketch()).add(values[a:b], weights[a:b])
        if len(held) > HELD:
            yield from _rows(held, part)
    yield from _rows(held, part)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch rows sorted by group, column and part -> one sketch for each, holding one at a time."""
    at, s = None, Sketch()
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        for group, column, part, level, size, data in zip(*columns):
            if (group, column, part) != at:
                if at is not None:
                    yield from _rows({at[:2]: s}, at[2])
                at, s = (group, column, part), Sketch()
            s.fold(level, size, data)
    if at is not None:
        yield from _rows({at[:2]: s}, at[2])


def sketch(df: DataFrame, groups: list[str], columns: list[str], weight: int = 1) -> DataFrame:
    """Partial sketches of each group and column, one per task that met it.

    Nulls and not-a-number are left out; infinities are the smallest and largest
    values. weight -1 makes the sketch of rows to take out. Groups may be null;
    other columns of df play no part. An empty df has no sketches.
    """
    group = F.to_json(F.struct(*[F.col(g).alias(g) for g in groups]), {"ignoreNullFields": "false"}) if groups else F.lit("{}")
    rows = df.select(group.alias("group_id"), F.lit(weight).cast("long").alias("weight"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)])
    return rows.mapInArrow(lambda it: _build(it, columns), SCHEMA)


def merge(sketches: DataFrame, fan_in: int = 64) -> DataFrame:
    """One sketch per group and column, added up in two steps of at most about ``fan_in`` and the rest, so that no task adds the sketches of all others."""
    parts = sketches.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(fan_in)).cast("int"))
    once = parts.repartition("group_id", "column", "part").sortWithinPartitions("group_id", "column", "part").mapInArrow(_add_up, SCHEMA)
    final = once.withColumn("part", F.lit(0)).repartition("group_id", "column").sortWithinPartitions("group_id", "column")
    return final.mapInArrow(_add_up, SCHEMA)


def _read(batches: Iterator[pa.RecordBatch], probabilities: list[float], sigmas: float) -> Iterator[pa.RecordBatch]:
    at, s = None, Sketch()

    def give(at: tuple[str, str], s: Sketch) -> pa.RecordBatch:
        n = len(probabilities)
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]] * n), pa.array([at[1]] * n), pa.array(probabilities, pa.float64()), pa.array(s.quantiles(probabilities), pa.float64()), pa.array([s.total] * n, pa.int64()), pa.array([sigmas * s.rank_error()] * n, pa.float64())],
            ["group_id", "column", "p", "value", "n", "rank_error"],
        )

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)]
        for group, column, level, size, data in zip(*columns):
            if (group, column) != at:
                if at is not None:
                    yield give(at, s)
                at, s = (group, column), Sketch()
            s.fold(level, size, data)
    if at is not None:
        yield give(at, s)


def quantiles(sketches: DataFrame, groups: dict[str, T.DataType], probabilities: list[float], sigmas: float = 3.0) -> DataFrame:
    """(groups, column, p, value, n, rank_error) of merged or partial sketches.

    value has a rank between (p - rank_error) n and (p + rank_error) n, with the
    confidence of ``sigmas`` standard errors. Groups of nothing (every row taken
    out again) have the value NaN and the error 0.
    """
    ready = merge(sketches).repartition("group_id", "column").sortWithinPartitions("group_id", "column")
    found = ready.mapInArrow(lambda it: _read(it, probabilities, sigmas), "group_id string, column string, p double, value double, n long, rank_error double")
    if not groups:
        return found.drop("group_id")
    schema = T.StructType([T.StructField(g, t) for g, t in groups.items()])
    parsed = found.withColumn("_g", F.from_json("group_id", schema))
    return parsed.select(*[F.col("_g")[g].alias(g) for g in groups], "column", "p", "value", "n", "rank_error")


def percentiles(df: DataFrame, groups: list[str], columns: list[str], probabilities: list[float]) -> DataFrame:
    return quantiles(sketch(df, groups, columns), {g: df.schema[g].dataType for g in groups}, probabilities)
