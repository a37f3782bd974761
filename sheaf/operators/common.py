"""Plumbing shared by the cell verbs (C17: apply a transform to addressed columns)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Wrangler
from ..plans.order import addresses


def _rows(rows) -> list[int]:
    rows = [rows] if isinstance(rows, int) else list(rows)
    for r in rows:
        if not isinstance(r, int) or isinstance(r, bool) or r < 0:
            raise ValueError(f"bad row index {r!r}")
    return rows



def check_range(w: Wrangler, rows) -> None:
    w.require_batch("a row-addressed verb")
    if not w.order:
        raise ValueError("row positions need a row order (order_by=)")
    if rows and not w.has_part:
        found = w.df.limit(max(rows) + 1).count()
        if found <= max(rows):
            raise ValueError(f"row {max(rows)} is out of range: the table has {found} rows")


def row_hit(w: Wrangler, rows) -> tuple[Wrangler, Column, str | None]:
    """(wrangler, condition for the addressed rows, helper column to drop). An index is the
    row's number in the order, ties and all; no rows address nothing. An index beyond the
    table raises; with a partition key, one beyond a partition addresses no row of it.

    The keys of the addressed rows are looked up (``plans.order.addresses``) and compared with
    each row where it is read. Rows are numbered only per partition, in text, where numbers need
    no exchange, and where an addressed row is equal to another in every column."""
    rows = _rows(rows)
    if not rows:
        return w, F.lit(False), None
    w.require_batch("a row-addressed verb")
    if not w.order:
        raise ValueError("row positions need a row order (order_by=)")
    if not w.has_part:
        out, hit, _, names = addresses(w, rows)
        if hit is not None:
            extra = [c for c in names if c not in w.df.columns]
            return out, hit, extra[0] if extra else None
        w = out
    check_range(w, rows)
    df, rid, w2 = w._rid()
    return w2._with(df=df), F.col(rid).isin(rows), rid


def map_cells(w: Wrangler, columns, fn: Callable[[Column], Column], rows=None) -> Wrangler:
    """Replace each addressed cell by ``fn(cell)``; with ``rows`` only in those rows
    (row index in the current order, per ``_part``)."""
    names = w.resolve(columns)
    if rows is None:
        return w.select_cells({c: fn(w.text(c)) for c in names})
    out, hit, helper = row_hit(w, rows)
    exprs = {c: F.when(hit, fn(w.text(c))).otherwise(w.text(c)) for c in names}
    res = out.select_cells(exprs)
    return res._with(df=res.df.drop(helper)) if helper else res

