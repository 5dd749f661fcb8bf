"""A table as ordered series: loading, slices by time and position, and changes.

A store never changes; appending, deleting and the like give a new one. On disk
it is a parquet table whose files hold whole ids in order, so that a slice of an
id reads few row groups.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import Series


@dataclass(frozen=True)
class Store:
    """Rows of series and how they are ordered. Positions are found when ``series`` is asked for, so slices by id and time are filters of the rows as they lie in storage."""

    rows: DataFrame
    ts: str
    ids: tuple[str, ...]
    order: tuple[str, ...]
    numbered: bool = False  # whether rows have positions already

    @classmethod
    def load(cls, df: DataFrame, ts: str, ids: list[str] | None = None, where: str | None = None, tie: list[str] | None = None, substitute_nulls: bool = False) -> Store:
        """Rows in order of time, with the columns of ``tie`` deciding among equal times. Null ids are an error where they are read; other nulls too, or 0 and '' with substitute_nulls."""
        rows = df.where(where) if where else df
        for c in ids or []:
            rows = rows.where(F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}")).cast("boolean")).otherwise(F.lit(True)))
        if substitute_nulls:
            rows = rows.na.fill(0).na.fill("")
        return cls(rows, ts, tuple(ids or []), (ts, *(tie or [])))

    @classmethod
    def read(cls, spark: SparkSession, path: str, ts: str, ids: list[str] | None = None) -> Store:
        return cls(spark.read.parquet(path), ts, tuple(ids or []), ("pos",), True)

    @property
    def series(self) -> Series:
        if self.numbered:
            return Series(self.rows, self.ids)
        s = Series.of(self.rows, list(self.order), self.ids)
        return Series(s.df.drop("_load"), s.ids, s.pos)

    @property
    def id_columns(self) -> tuple[str, ...]:
        return self.ids

    @property
    def timestamp_column(self) -> str:
        return self.ts

    def save(self, path: str) -> None:
        """By id and time; a range partitioning keeps a long id in several files."""
        order = [*self.ids, "pos"]
        self.series.df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)

    def _with(self, rows: DataFrame) -> Store:
        """Other rows, in the same order."""
        return replace(self, rows=rows, numbered=False)

    def _of_series(self, s: Series) -> Store:
        return replace(self, rows=s.df, order=(s.pos,), numbered=True)

    def _times(self, first, last) -> Column:
        t = F.col(self.ts)
        return (F.lit(True) if first is None else t >= F.lit(first)) & (F.lit(True) if last is None else t <= F.lit(last))

    def _among(self, ids) -> Column:
        if ids is None:
            return F.lit(True)
        return F.col(self.ids[0]).isin(list(ids) if isinstance(ids, (list, tuple, set)) else [ids])

    def get(self, ids=None, first=None, last=None, limit: int | None = None) -> Store:
        """Elements from first to last time, both included. limit keeps the first so many, or the last if no first time is given. Ids and times are filters of the storage."""
        part = self._with(self.rows.where(self._among(ids) & self._times(first, last)))
        if limit is None:
            return part
        w = Window.partitionBy(*self.ids).orderBy(*[F.col(c).desc_nulls_last() if first is None else F.col(c).asc_nulls_first() for c in self.order])
        return self._with(part.rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k"))

    def span(self, ids=None, first: int = 0, last: int | None = None) -> Store:
        """Elements from first to last position; negative ones count from the end."""
        from ..operators.reshape import limit

        return self._of_series(limit(replace(self, rows=self.rows.where(self._among(ids))).series, first, last))

    def concat(self, ids: list, first=None, last=None) -> Series:
        """The given ids' elements one after the other, as one series without time. Missing ids are skipped; every id's place follows from the sizes of those before it."""
        part = self.get(ids, first, last).series
        name = part.ids[0]
        order = self.rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(ids)], f"`{name}` {part.df.schema[name].dataType.simpleString()}, _o int")
        sizes = part.df.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).join(order, name)
        # one row per id asked for
        before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rows = part.df.join(F.broadcast(before.select(name, "_base")), name).withColumn(part.pos, F.col(part.pos) + F.col("_base"))
        return Series(rows.drop("_base", self.ts, name), (), part.pos)

    def first(self, ids=None) -> DataFrame:
        return self.rows.where(self._among(ids)).groupBy(*self.ids).agg(F.min(self.ts).alias("first_ts"))

    def last(self, ids=None) -> DataFrame:
        return self.rows.where(self._among(ids)).groupBy(*self.ids).agg(F.max(self.ts).alias("last_ts"))

    def count(self, ids=None) -> DataFrame:
        return self.rows.where(self._among(ids)).groupBy(*self.ids).agg(F.count(F.lit(1)).alias("n"))

    def append(self, rows: DataFrame, since=None) -> Store:
        """With rows from a time on, which come after those of equal time that are there. A row older than its id's last is an error."""
        new = rows.where(F.col(self.ts) >= F.lit(since)) if since is not None else rows
        old = self.rows if "_load" in self.rows.columns else self.rows.withColumn("_load", F.lit(0))
        load = int(old.agg(F.max("_load")).first()[0] or 0) + 1 if "_load" in self.rows.columns else 1
        if self.ids:
            joined = new.join(self.rows.groupBy(*self.ids).agg(F.max(self.ts).alias("_last")), list(self.ids), "left")
        else:
            # one value for the whole store
            joined = new.withColumn("_last", F.lit(self.rows.agg(F.max(self.ts)).first()[0]).cast(new.schema[self.ts].dataType))
        late = F.col(self.ts) < F.col("_last")
        checked = joined.withColumn(self.ts, F.when(late, F.raise_error(F.lit("out of order")).cast(rows.schema[self.ts].dataType)).otherwise(F.col(self.ts)))
        order = (self.ts, "_load", *[c for c in self.order if c not in (self.ts, "_load")])
        return replace(self, rows=old.unionByName(checked.withColumn("_load", F.lit(load)).select(*[c for c in old.columns if c != "pos"]), allowMissingColumns=True), order=order, numbered=False)

    def delete(self, ids=None, first=None, last=None) -> Store:
        """Without the elements from first to last time."""
        return self._with(self.rows.where(~(self._times(first, last) & self._among(ids))))

    def truncate(self) -> Store:
        return replace(self, rows=self.rows.where(F.lit(False)))

    def load_column(self, df: DataFrame, column: str, keys: list[str]) -> Store:
        """With one more column, taken from df by the given key columns."""
        return replace(self, rows=self.rows.join(df.select(*keys, column), keys, "left"))

    def truncate_column(self, column: str) -> Store:
        return replace(self, rows=self.rows.drop(column))

    def project(self, positions: DataFrame | None = None) -> DataFrame:
        """Rows: all, or those at given (ids, pos)."""
        s = self.series
        return s.df if positions is None else s.df.join(positions, [*s.ids, s.pos], "left_semi")

    def cache(self) -> Store:
        return replace(self, rows=self.rows.persist())

    def is_loaded(self) -> bool:
        return bool(self.rows.is_cached)

    def drop(self) -> None:
        self.rows.unpersist()


def used_memory(spark: SparkSession) -> int:
    """Bytes of memory and disk that cached frames hold."""
    return sum(i.memSize() + i.diskSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo())


def delete_all(spark: SparkSession) -> int:
    """Forget all cached frames; how many held anything."""
    n = len(spark.sparkContext._jsc.sc().getRDDStorageInfo())
    spark.catalog.clearCache()
    return n


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """CSV with a given schema: no pass to infer one."""
    return spark.read.schema(schema).options(**options).csv(path)
