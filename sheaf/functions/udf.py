"""Arbitrary Python cell functions, Arrow-batched.

The built-in Column helpers are the fast path. When a cell function really
needs Python, wrap it here: it runs per Arrow batch in a pandas UDF, and an
exception in one cell gives null for that cell (which the verbs read as
"unchanged" for cut/split/extract and as "keep" for delete).
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def _safe(fn):
    def call(x):
        if x is None:
            return None
        try:
            return fn(x)
        except Exception:  # noqa: BLE001 - per-cell failure means "no value"
            return None

    return call


def cell_fn(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """``str -> str`` Python function as a ``Column -> Column`` function."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_safe(fn))

    return lambda c: run(c)


def cell_pred(fn: Callable[[str], bool]) -> Callable[[Column], Column]:
    """``str -> bool`` Python predicate as a ``Column -> Column`` predicate."""

    @pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_safe(fn)).astype("boolean")

    return lambda c: run(c)
