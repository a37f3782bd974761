"""fill: propagate values into blank cells.

Up/down fills follow the row order with the bucket+carry plan (no
single-task window); left/right fills are row-local ``coalesce`` chains.
A cell is blank when it is null or '' (default), equals ``blank`` (a string,
G6) or satisfies ``blank`` (a Column predicate, G7).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Wrangler
from ..functions.text import blank as is_empty
from ..plans.order import addresses, is_one_of, ordered_scan
from .common import _rows, check_range, row_hit


def blank_test(blank) -> Callable[[Column], Column]:
    if blank is None:
        return is_empty
    if isinstance(blank, str):
        return lambda c: c.isNull() | (c == F.lit(blank))
    if callable(blank):
        return lambda c: c.isNull() | F.coalesce(blank(c), F.lit(False))
    raise ValueError(f"bad blank test {blank!r}")


def _vertical(w: Wrangler, columns, blank, down: bool) -> Wrangler:
    w.require_batch("fill up/down")
    test = blank_test(blank)
    names = w.resolve(columns)
    outs = {w.fresh(f"__fill{i}"): n for i, n in enumerate(names)}
    exprs = {o: F.when(~test(w.text(n)), w.text(n)) for o, n in outs.items()}
    df, w2 = ordered_scan(w, ffill=exprs) if down else ordered_scan(w, bfill=exprs)
    res = w2._with(df=df).select_cells(
        {n: F.when(test(w.text(n)), F.coalesce(F.col(o), w.text(n))).otherwise(w.text(n))
         for o, n in outs.items()})
    return res._with(df=res.df.drop(*outs))


def fill_down(w: Wrangler, columns=None, blank=None) -> Wrangler:
    """G1: a blank takes the nearest non-blank value above it (leading blanks stay)."""
    return _vertical(w, columns, blank, down=True)


def fill_up(w: Wrangler, columns=None, blank=None) -> Wrangler:
    """A blank takes the nearest non-blank value below it."""
    return _vertical(w, columns, blank, down=False)


def fill_side(w: Wrangler, direction: str, columns=None, rows=None, blank=None) -> Wrangler:
    """G3 (left: from lower columns) / G4 (right: from higher columns), among the
    addressed columns in table order; optionally only in ``rows``."""
    test = blank_test(blank)
    names = [c for c in w.cells if c in set(w.resolve(columns))]
    if direction == "right":
        names = names[::-1]
    exprs = {}
    for k, n in enumerate(names):
        cands = [F.when(~test(w.text(m)), w.text(m)) for m in names[k::-1]]
        exprs[n] = F.coalesce(*cands, w.text(n))
    if rows is None:
        return w.select_cells(exprs)
    out, hit, helper = row_hit(w, rows)
    res = out.select_cells({n: F.when(hit, e).otherwise(w.text(n)) for n, e in exprs.items()})
    return res._with(df=res.df.drop(helper)) if helper else res


def fill_column(w: Wrangler, source, target, blank=None) -> Wrangler:
    """Blank cells of ``target`` column(s) take the ``source`` column's value."""
    (src,) = w.resolve(source)
    test = blank_test(blank)
    return w.select_cells({t: F.when(test(w.text(t)), w.text(src)).otherwise(w.text(t))
                           for t in w.resolve(target)})


def fill_row(w: Wrangler, source: int, target, columns=None, blank=None) -> Wrangler:
    """Blank cells of the ``target`` row(s) take row ``source``'s value
    (per ``_part``). The source row is one row per partition key."""
    test = blank_test(blank)
    names = w.resolve(columns)
    tgt = _rows(target)
    if not tgt:
        check_range(w, [source])
        return w
    if not w.has_part and not w.prefix_unbounded and w.order:
        w.require_batch("fill_row")
        out, hit, key_of, keys = addresses(w, [source, *tgt])
        if hit is not None:  # one row's cells, as literals; nothing is moved
            cells = out.df.filter(is_one_of(out.df, keys, [key_of[source]])).select(*[w.text(n).alias(n) for n in names]).first()
            here = is_one_of(out.df, keys, list(dict.fromkeys(key_of[r] for r in tgt)))
            res = out.select_cells({n: F.when(here & test(w.text(n)), F.lit(cells[n])).otherwise(w.text(n))
                                    for n in names if cells[n] is not None})
            return res._with(df=res.df.drop(*[c for c in keys if c not in w.df.columns]), same_rows=True)
    check_range(w, [source, *tgt])
    # Spread the source row's cells over its table or partition with a
    # forward and a backward fill in row order (bucketed, so a partition
    # holding a third of all rows is still spread over all tasks; no join on
    # the partition key).
    df, rid, w2 = w._rid()
    marked = w2._with(df=df)
    fwd = {w2.fresh(f"__sf{i}", extra=[rid]): n for i, n in enumerate(names)}
    bwd = {w2.fresh(f"__sb{i}", extra=[rid, *fwd]): n for i, n in enumerate(names)}
    is_src = F.col(rid) == source
    df2, w3 = ordered_scan(
        marked,
        ffill={o: F.when(is_src, w.text(n)) for o, n in fwd.items()},
        bfill={o: F.when(is_src, w.text(n)) for o, n in bwd.items()})
    hit = F.col(rid).isin(tgt)
    exprs = {}
    for (fo, n), bo in zip(fwd.items(), bwd):
        src = F.coalesce(F.col(fo), F.col(bo))
        exprs[n] = F.when(hit & test(w.text(n)) & src.isNotNull(), src).otherwise(w.text(n))
    res = w3._with(df=df2).select_cells(exprs)
    return res._with(df=res.df.drop(rid, *fwd, *bwd))


def fill(w: Wrangler, direction: str = "down", columns=None, rows=None, blank=None) -> Wrangler:
    if direction == "down":
        if rows is not None:
            raise ValueError("fill down works on whole columns")
        return fill_down(w, columns, blank)
    if direction == "up":
        if rows is not None:
            raise ValueError("fill up works on whole columns")
        return fill_up(w, columns, blank)
    if direction in ("left", "right"):
        return fill_side(w, direction, columns, rows, blank)
    raise ValueError(f"unknown direction {direction!r}")
