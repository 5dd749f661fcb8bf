"""Time as whole numbers: microseconds or days since 1970-01-01, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_A_DAY = 86_400_000_000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a timestamp without zone as written, of a timestamp with zone as an instant, of a date at its start; whole numbers stay."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(F.to_date(c)).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * MICROS_A_DAY
    return c.cast("long")


def axis(df: DataFrame, name: str) -> Column:
    """Days of a date, microseconds of a timestamp, other whole numbers as they are."""
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.unix_date(F.col(f"`{name}`")).cast("long")
    return micros(df, name)


def day_string(days: Column) -> Column:
    return F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd")
