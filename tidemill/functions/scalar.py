"""Element-wise functions with the arithmetic of machine numbers: they fail on overflow of whole numbers, never on a float.

Whole numbers are computed as longs. Division by zero gives null for whole
numbers and an infinity or not-a-number for floats. Comparisons with
not-a-number are false, except ``ne``. Numbers, strings, dates and times are compared
alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = F.lit, float("inf")
EPOCH = "2000-01-01"


def nan() -> Column:
    return F.lit(float("nan"))


def div(a: Column, b: Column) -> Column:
    """Float division: x/0 is an infinity with the sign of x, 0/0 is not-a-number."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(a) | (a == 0), nan()).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(F.try_divide(a, b))


def int_div(a: Column, b: Column) -> Column:
    """Whole division, towards zero; by zero null."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0)))


def mod(a: Column, b: Column) -> Column:
    """Remainder of floats with the sign of a; by zero not-a-number. Whole numbers beyond 2 ** 53 need int_mod."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, nan()).otherwise(F.try_mod(a, b))


def int_mod(a: Column, b: Column) -> Column:
    return F.try_mod(a.cast("long"), b.cast("long"))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def _real(c: Column) -> Column:
    """Not not-a-number. Of other types than floats, which the optimizer knows, nothing is tested."""
    return F.when(F.typeof(c).isin("float", "double"), c.cast("string") != "NaN").otherwise(F.lit(True))


def eq(a: Column, b: Column) -> Column:
    return (a == b) & _real(a)


def ne(a: Column, b: Column) -> Column:
    return ~eq(a, b)


def lt(a: Column, b: Column) -> Column:
    return (a < b) & _real(b)


def le(a: Column, b: Column) -> Column:
    return (a <= b) & _real(b)


def gt(a: Column, b: Column) -> Column:
    return (a > b) & _real(a)


def ge(a: Column, b: Column) -> Column:
    return (a >= b) & _real(a)


def maxof(a: Column, b: Column) -> Column:
    """a where it is greater, else b; null where either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.when(gt(a, b), a).otherwise(b))


def minof(a: Column, b: Column) -> Column:
    """a where it is less, else b; null where either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.when(lt(a, b), a).otherwise(b))


def join_strings(a: Column, b: Column) -> Column:
    """b's characters after a's; null where either is."""
    return F.concat(a, b)


def log(x: Column) -> Column:
    """Natural logarithm: of 0 minus infinity, below not-a-number."""
    x = x.cast("double")
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), nan())


#: Functions of one double; outside their domain they give not-a-number.
MATH = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sqrt": F.sqrt, "log": log,
    "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"),
}


def math(name: str, x: Column) -> Column:
    return MATH[name](x.cast("double"))


def days2000(d: Column) -> Column:
    """Days since 2000-01-01, on which date arithmetic works."""
    return F.datediff(F.to_date(d), F.lit(EPOCH).cast("date"))


def week(d: Column) -> Column:
    """Weeks since 2000-01-01, which change with Sunday."""
    return F.call_function("div", days2000(d) - wday(d), F.lit(7))


def wday(d: Column) -> Column:
    """Day of the week, 0 for Sunday."""
    return F.dayofweek(F.to_date(d)) - 1


CALENDAR = {"year": F.year, "month": F.month, "mday": F.dayofmonth, "wday": wday, "week": week, "quarter": F.quarter}
CLOCK = {"hour": F.hour, "minute": F.minute, "second": F.second}


def pattern(p: str) -> str:
    """A pattern with % for any text, ? for one character and \\ as escape, for LIKE, where _ is the one character."""
    out, k = [], 0
    while k < len(p):
        c = p[k]
        if c == "\\" and k + 1 < len(p):
            k += 1
            out.append("\\" + p[k] if p[k] in "%_\\" else p[k])
        else:
            out.append({"?": "_", "_": "\\_"}.get(c, c))
        k += 1
    return "".join(out)


def like(s: Column, p: str) -> Column:
    return s.like(pattern(p))


def ilike(s: Column, p: str) -> Column:
    return s.ilike(pattern(p))


def cat(**parts: Column) -> Column:
    """A compound key."""
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def cut(key: Column, **types: str) -> list[Column]:
    """The parts of a compound key, cast."""
    return [key[n].cast(t).alias(n) for n, t in types.items()]


def as_type(key: Column, kind: str) -> Column:
    """A compound key as a struct of other field names or types, field by field."""
    return key.cast(kind)


def as_array(key: Column, names: list[str]) -> Column:
    return F.array(*[key[n].cast("string") for n in names])
