"""A frame of ordered series: one row per element, with its position within its id.

A sequence is a column of such a frame. Functions of single elements are plain
column expressions (``functions``); those that depend on order take the frame.
Positions count from 0 within each id and are renumbered when rows go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .plans.single import positions


@dataclass(frozen=True)
class Series:
    df: DataFrame
    ids: tuple[str, ...]
    pos: str = "pos"

    @classmethod
    def of(cls, df: DataFrame, order: list[str], ids: list[str] | tuple[str, ...] = (), pos: str = "pos", spread: bool = False) -> Series:
        """Positions by ``order`` within ``ids``.

        Without ids, or with ``spread`` for ids of which one may hold a large share
        of the rows, they are found chunk by chunk and not in one window an id.
        ``order`` should be total: rows equal in it get positions in no particular
        order.
        """
        if not ids or spread:
            return cls(positions(df, order, pos, ids), tuple(ids), pos)
        w = Window.partitionBy(*ids).orderBy(*[F.col(c).asc_nulls_first() for c in order])
        return cls(df.withColumn(pos, (F.row_number().over(w) - 1).cast("long")), tuple(ids), pos)

    @property
    def w(self):
        """Order of the elements of an id."""
        return Window.partitionBy(*self.ids).orderBy(self.pos)

    @property
    def back(self):
        return Window.partitionBy(*self.ids).orderBy(F.col(self.pos).desc())

    @property
    def upto(self):
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self):
        return Window.partitionBy(*self.ids)

    def trailing(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def with_column(self, name: str, c: Column) -> Series:
        return Series(self.df.withColumn(name, c), self.ids, self.pos)

    def renumbered(self) -> Series:
        return self.with_column(self.pos, (F.row_number().over(self.w) - 1).cast("long"))

    def where(self, condition: Column | str) -> Series:
        return Series(self.df.where(condition), self.ids, self.pos).renumbered()

    def keep(self, *columns: str) -> DataFrame:
        """Ids, position and the named columns."""
        return self.df.select(*self.ids, self.pos, *columns)
