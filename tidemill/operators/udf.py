"""Functions of the user's own per element, and counters of what was called."""

from __future__ import annotations

import functools
import inspect
import logging
from collections import Counter
from collections.abc import Callable
from types import ModuleType

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_calls: Counter[str] = Counter()
_log = logging.getLogger("tidemill")
_tracing = False


def call(c: Column, f: str | Callable[[pd.Series], pd.Series], result: str = "double") -> Column:
    """f of every element: the name of a built-in function, or a function of pandas series, called for Arrow batches. A null result is an error."""
    name = f if isinstance(f, str) else getattr(f, "__name__", "function")
    count_call(name)
    out = F.call_function(f, c) if isinstance(f, str) else F.pandas_udf(f, result)(c)
    return F.when(out.isNull(), F.raise_error(F.lit(f"{name} returned null")).cast(result)).otherwise(out)


def count_call(name: str) -> None:
    _calls[name] += 1
    if _tracing:
        _log.info("%s", name)


def trace(on: bool) -> None:
    """Whether every counted call is logged."""
    global _tracing
    _tracing = on


def watch(*modules: ModuleType) -> None:
    """Count the calls of every public function of these modules, as module.function."""
    for module in modules:
        for name, f in list(vars(module).items()):
            if inspect.isfunction(f) and f.__module__ == module.__name__ and not name.startswith("_") and not hasattr(f, "_watched"):
                label = f"{module.__name__.rsplit('.', 1)[-1]}.{name}"

                @functools.wraps(f)
                def counted(*args, _f=f, _label=label, **kwargs):
                    count_call(_label)
                    return _f(*args, **kwargs)

                counted._watched = True
                setattr(module, name, counted)


def profile(spark: SparkSession, reset: bool = False) -> DataFrame:
    """(command, counter) of this driver's calls and their TOTAL."""
    rows = [*sorted(_calls.items()), ("TOTAL", sum(_calls.values()))]
    if reset:
        _calls.clear()
    return spark.createDataFrame(rows, "command string, counter long")
