"""Element types, their promotion, and values as sequences write them."""

from __future__ import annotations

import datetime
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark type of each element type, in the order of promotion (fixed values).
TYPES = {
    "char": "byte", "bool": "byte", "int2": "short", "int4": "int", "date": "date", "int8": "bigint", "time": "bigint", "timestamp": "timestamp_ntz",
    "money": "decimal(19,2)", "float4": "float", "float8": "double", "bpchar": "string", "varchar": "string",
}
RANK = {name: k for k, name in enumerate(TYPES)}


def promote(a: str, b: str) -> str:
    """Type of a binary operation: that of higher rank."""
    return a if RANK[a] >= RANK[b] else b


def const(value, kind: str) -> Column:
    """A constant of the given type; a number is narrowed as the type's whole numbers are."""
    if kind in ("char", "bool", "int2", "int4", "int8") and isinstance(value, float):
        value = int(value)
    return F.lit(value).cast(TYPES[kind])


def cast(c: Column, source: str, target: str, length: int | None = None) -> Column:
    """A value of one type as another. Floats lose their fraction, timestamps give the day or the microseconds of the day, money counts in cents only inside."""
    if target == "time" and source == "timestamp":
        return (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    out = c.cast(TYPES[target])
    return F.substring(out, 1, length) if target in ("bpchar", "varchar") and length else out


#: Bytes of an element of each Spark type (fixed values); strings have no size of their own.
SIZES = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "date": 4, "float": 4, "bigint": 8, "timestamp_ntz": 8, "timestamp": 8, "double": 8, "decimal(19,2)": 8}


def type_of(df: DataFrame, column: str) -> str:
    """Element type of a column, by its Spark type; of types that share one the first."""
    kind = df.select(column).schema[0].dataType.simpleString()
    alias = {"tinyint": "byte", "smallint": "short", "timestamp": "timestamp_ntz"}.get(kind, kind)
    for name, spark_type in TYPES.items():
        if spark_type == alias:
            return name
    raise ValueError(f"no element type for {kind}")


def elem_size(df: DataFrame, column: str) -> int | None:
    """Bytes of an element, null for strings."""
    return SIZES.get(df.select(column).schema[0].dataType.simpleString())


_ITEM = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^,{}]*))\s*(,|$)')


def _value(text: str, kind: str):
    if kind in ("bpchar", "varchar"):
        return text
    if kind in ("char", "bool", "int2", "int4", "int8", "time"):
        t = text.strip()
        octal = re.fullmatch(r"([+-]?)0([0-7]+)", t)
        return int(octal[1] + octal[2], 8) if octal else int(t, 0)
    if kind in ("float4", "float8"):
        return float(text)
    if kind == "money":
        return Decimal(text.replace("$", "").replace(",", "")).quantize(Decimal("0.01"))
    for form in ("%d-%b-%Y", "%Y-%m-%d") if kind == "date" else ("%d-%b-%Y %H:%M:%S", "%d-%b-%Y %H:%M", "%d-%b-%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d"):
        try:
            at = datetime.datetime.strptime(text.strip(), form)
            return at.date() if kind == "date" else at
        except ValueError:
            continue
    raise ValueError(f"not a {kind}: {text}")


def parse(text: str, kind: str | None = None) -> tuple[list, str]:
    """Values and type of a literal such as ``int4:{1,2,3}``; hexadecimal and octal whole numbers are understood, commas may stand within quotes."""
    head, _, body = text.partition("{")
    if head.strip():
        kind = head.strip().rstrip(":")
    kind = re.sub(r"\d+$", "", kind) if kind and kind.startswith(("bpchar", "varchar")) else kind
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind}")
    if not body.rstrip().endswith("}"):
        raise ValueError("a sequence ends with }")
    body, out, at = body.rstrip()[:-1], [], 0
    while body.strip() and at <= len(body):
        m = _ITEM.match(body, at)
        if not m:
            raise ValueError(f"can't read {body[at:]!r}")
        out.append(_value(re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2].strip(), kind))
        at = m.end()
        if m[3] != ",":
            break
    return out, kind


def sequence(spark: SparkSession, text: str, kind: str | None = None, name: str = "v") -> DataFrame:
    """(pos, name) of a literal."""
    values, kind = parse(text, kind)
    typed = {"byte": "tinyint", "short": "smallint"}.get(TYPES[kind], TYPES[kind])
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"pos bigint, {name} {typed}")


def to_array(df: DataFrame, ids: list[str], pos: str, value: str, name: str = "items") -> DataFrame:
    """One array per id, in order. An array is one row, so an id's series must fit into one."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, value)))
    return df.groupBy(*ids).agg(F.transform(ordered, lambda x: x[value]).alias(name))


def from_array(df: DataFrame, array: str, pos: str = "pos", value: str = "v") -> DataFrame:
    keep = [c for c in df.columns if c != array]
    return df.select(*keep, F.posexplode(array).alias("_p", value)).withColumn(pos, F.col("_p").cast("long")).drop("_p")


def to_text(df: DataFrame, ids: list[str], pos: str, value: str, limit: int = 100, name: str = "text") -> DataFrame:
    """The first ``limit`` elements as text."""
    head = to_array(df.where(F.col(pos) <= limit), ids, pos, value, "_a")
    shown = F.concat_ws(",", F.transform(F.slice("_a", 1, limit), lambda x: x.cast("string")))
    return head.select(*ids, F.concat(F.lit("{"), shown, F.when(F.size("_a") > limit, F.lit(",...")).otherwise(F.lit("")), F.lit("}")).alias(name))
