"""Partition and set verbs (M1-M5).

A "set of tables" is ONE DataFrame with a ``_part`` key column: no driver
round trip, no per-table lineage. Row-local verbs ignore it; ordered verbs add
it to their window partitioning; the text sink writes one folder per key.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import HIDDEN, PART, Wrangler


def partition(w: Wrangler, fn: Callable[[Column], Column] | None = None, column=0) -> Wrangler:
    """M1: ``_part = fn(cell of column)`` (identity when ``fn`` is None)."""
    (name,) = w.resolve(column)
    c = w.text(name)
    key = fn(c) if fn is not None else c
    return w._with(df=w.df.withColumn(PART, key.cast("string")))


def union(a: Wrangler, b: Wrangler) -> Wrangler:
    """M3: append ``b``'s rows under ``a``'s header, by position. A narrower side
    is padded with ''; extra columns of ``b`` get default names. Row order:
    all of ``a`` (in its order) then all of ``b``."""
    ac, bc = a.cells, b.cells
    width = max(len(ac), len(bc))
    names = list(ac) + [f"c{i}" for i in range(len(ac), width)]
    taken = set(ac)
    for i in range(len(ac), width):
        while names[i] in taken:
            names[i] += "_"
        taken.add(names[i])

    def cells(w, cols):
        return [(w.text(cols[i]) if i < len(cols) else F.lit("")).alias(names[i])
                for i in range(width)]

    same_order = (len(a.order) == len(b.order) and len(a.order) > 0 and all(
        a.dtype(x) == b.dtype(y) for x, y in zip(a.order, b.order)))
    part = [PART] if (a.has_part or b.has_part) else []

    def side(w, tag):
        sel = cells(w, w.cells)
        if part:
            sel.append((F.col(PART) if w.has_part else F.lit(None).cast("string")).alias(PART))
        if same_order:
            sel += [F.col(x).alias(y) for x, y in zip(w.order, a.order)]
            sel.append(F.lit(tag).alias(f"{HIDDEN}src"))
        return w.df.select(*sel)

    out = side(a, 0).unionByName(side(b, 1))
    if not same_order:
        return Wrangler._raw(out, depth=max(a.depth, b.depth))
    src = f"{HIDDEN}src"
    return Wrangler._raw(out, order=(src,) + a.order, prefix=(src,) + a.prefix, qkey=a.qkey,
                         prefix_unbounded=a.prefix_unbounded or b.prefix_unbounded,
                         depth=max(a.depth, b.depth))


def merge_parts(w: Wrangler, keys: list | None = None) -> Wrangler:
    """M4: all partitions back into one table, or only those in ``keys``."""
    if not w.has_part:
        return w
    df = w.df if keys is None else w.df.filter(F.col(PART).isin([str(k) for k in keys]))
    return w._with(df=df.drop(PART))
