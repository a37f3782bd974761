"""Header verbs (H1-H3) and row / column removal and merging."""

from __future__ import annotations

import warnings
from functools import reduce
from typing import Callable

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

from ..frame import Wrangler, inner, outer
from ..functions.text import regex_found
from ..match import Regex
from ..plans.order import addresses, is_one_of, ordered_scan, sort_keys, tie_break
from .common import row_hit


def take_row(w: Wrangler, i: int) -> tuple[Row | None, Wrangler]:
    """Row ``i`` of the whole order, its cells as text, and the table without it. Only this row
    reaches the driver. Where keys tell rows apart, the row is told by its key; otherwise, and
    for text sources, whose keys depend on how files are cut into splits, by its number."""
    w.require_batch("row access")
    if not w.order:
        raise ValueError("row positions need a row order (order_by=)")
    cells = [w.text(c).alias(c) for c in w.cells]
    if w.prefix_unbounded:
        if i == 0:
            found = w.df.orderBy(*sort_keys(w)).limit(1)
        else:
            df, rid, _ = w._with(df=w.df.drop(*w.part_cols), same_rows=True)._rid()
            found = df.filter(F.col(rid) == i)
        rows = found.select(*cells, *w.order).collect()
        if not rows:
            return None, w
        if w.has_part:
            return rows[0], w._with(df=w.df.filter(~is_one_of(w.df, list(w.order), [tuple(rows[0][c] for c in w.order)])))
        df, rid, w2 = w._rid()
        return rows[0], w2._with(df=df.filter(F.col(rid) != i).drop(rid))
    if i == 0:  # keys alone show the row and whether the next one shares its key
        top = w.keys.select(*w.order).orderBy(*[F.col(c).asc_nulls_first() for c in w.order]).limit(2).collect()
        keys = [tuple(r) for r in top]
        if not keys:
            return None, w
        if len(keys) == 1 or keys[0] != keys[1]:
            here = is_one_of(w.df, list(w.order), keys[:1])
            return w.df.filter(here).select(*cells).first(), w._with(df=w.df.filter(~here))
    whole = w._with(df=w.df.drop(*w.part_cols))
    out, hit, _, names = addresses(whole, [i])
    if hit is None:
        df, rid, w2 = whole._rid()
        row = df.filter(F.col(rid) == i).select(*cells).first()
        if w.has_part:
            raise ValueError("rows equal in every column: merge_parts() before promoting one")
        return row, w2._with(df=df.filter(F.col(rid) != i).drop(rid))
    extra = [c for c in names if c not in whole.df.columns]
    df = w.df.withColumns({c: tie_break(whole.df) for c in extra})
    return out.df.filter(hit).select(*cells).first(), w._with(df=df.filter(~hit).drop(*extra), bounds=out.bounds)


def promote(w: Wrangler, names=None, row=None) -> Wrangler:
    """H1 (``names``) / H2 (``row``, default 0): set the header."""
    if names is not None and row is not None:
        raise ValueError("give names= or row=, not both")
    cols = w.cells
    if names is not None:
        names = list(names)
        if len(set(names)) != len(names):
            raise ValueError(f"duplicate header names {names}")
        if len(names) > len(cols):
            raise ValueError(f"{len(names)} names for {len(cols)} columns")
        new = {c: inner(n) for c, n in zip(cols, names)}
        final = [new.get(c, c) for c in cols]
        if len(set(final)) != len(final):
            raise ValueError(f"header would not be unique: {[outer(c) for c in final]}")
        return w.renamed(new)
    i = 0 if row is None else row
    if i < 0:
        raise ValueError(f"negative row {i}")
    r, rest = take_row(w, i)
    if r is None:
        raise ValueError(f"cannot promote row {i}: the table is shorter")
    header = [r[c] if r[c] not in (None, "") else f"c{k}" for k, c in enumerate(cols)]
    if len(set(header)) != len(header):
        raise ValueError(f"row {i} would give a non-unique header: {header}")
    return promote(rest, names=header)


def demote(w: Wrangler, row: int = 0) -> Wrangler:
    """H3: insert the header as data row ``row`` (per ``_part``); columns become c0..cN. The
    new row takes its place from the row there, which is found when the plan runs."""
    w.require_batch("demote")
    if row < 0:
        raise ValueError(f"negative row {row}")
    if not w.order:
        raise ValueError("demote needs a row order (order_by=)")
    cols = w.cells
    generic = [f"c{k}" for k in range(len(cols))]
    ins = w.fresh("__ins")
    base = w.df.select(*[w.text(c).alias(g) for c, g in zip(cols, generic)],
                       *[c for c in w.df.columns if c not in cols]).withColumn(ins, F.lit(0))
    header = [F.lit(outer(c)).alias(g) for c, g in zip(cols, generic)]
    if not w.has_part:
        found = w.df.limit(row + 1).count()
        if found < row:
            raise ValueError(f"cannot demote to row {row}: the table is shorter")
        if found == 0:  # no row to stand beside
            types = dict(w.df.dtypes)
            new = w.spark.range(1).select(*header, *[F.lit(None).cast(types[c]).alias(c) for c in w.order],
                                          F.lit(-1).alias(ins))
            out = base.unionByName(new, allowMissingColumns=True)
            return w._with(df=out, order=w.order + (ins,))
    rid, tot = w.fresh("__rid"), w.fresh("__tot")
    df, w2 = ordered_scan(w, rid=rid, count=tot)
    anchor = df.filter((F.col(rid) == row) | ((F.col(rid) == row - 1) & (F.col(tot) == row)))
    new = anchor.select(*header, *w.part_cols, *w.order,
                        F.when(F.col(rid) == row, F.lit(-1)).otherwise(F.lit(1)).alias(ins))
    out = base.unionByName(new, allowMissingColumns=True)
    return w._with(df=out, order=w.order + (ins,), depth=w2.depth)


def delete(w: Wrangler, pred: Callable[[Column], Column] | None = None, columns=None,
           where=None, rows=None) -> Wrangler:
    """F1 (``pred`` true in any addressed column), F3 (``where`` regex found in
    any addressed column; optionally only in ``rows``), F2 (``rows`` alone).
    A null predicate keeps the row."""
    if pred is not None and where is not None:
        raise ValueError("give pred= or where=, not both")
    names = w.resolve(columns)
    cond = None
    if pred is not None:
        cond = reduce(lambda a, b: a | b, [pred(w.text(c)) for c in names])
    elif where is not None:
        pat = where.pattern if isinstance(where, Regex) else where
        cond = reduce(lambda a, b: a | b, [regex_found(w.text(c), pat) for c in names])
    if rows is None:
        if cond is None:
            raise ValueError("nothing to delete: give pred=, where= or rows=")
        return w._with(df=w.df.filter(~F.coalesce(cond, F.lit(False))))
    out, hit, helper = row_hit(w, rows)
    if cond is not None:
        hit = hit & F.coalesce(cond, F.lit(False))
    df = out.df.filter(~F.coalesce(hit, F.lit(False)))
    return out._with(df=df.drop(helper) if helper else df)


def merge(w: Wrangler, columns, glue: str = ",", name: str | None = None,
          placement: str = "first") -> Wrangler:
    """Concatenate columns (table order) with ``glue``; nulls count as ''.

    ``placement='first'``: at the first merged column; ``'auto'``: there if the
    columns are neighbours, else appended at the end (the tested in-memory rule).
    """
    names = w.resolve(columns)
    if len(names) < 2:
        warnings.warn("merge needs at least two columns; nothing merged")
        return w
    cols = w.cells
    idx = sorted(cols.index(c) for c in names)
    ordered = [cols[i] for i in idx]
    out_name = inner(name or "".join(map(outer, ordered)))
    others = [c for c in cols if c not in names]
    if out_name in others:
        raise ValueError(f"merged column name {outer(out_name)!r} already exists")
    merged = F.concat_ws(glue, *[F.coalesce(w.text(c), F.lit("")) for c in ordered]).alias(out_name)
    neighbours = all(b == a + 1 for a, b in zip(idx, idx[1:]))
    sel = []
    for c in w.df.columns:
        if c == ordered[0] and (placement == "first" or neighbours):
            sel.append(merged)
        elif c not in names:
            sel.append(F.col(c))
    if placement == "auto" and not neighbours:
        sel = sel + [merged]
    df = w.df.select(*sel)
    # keep hidden / part columns after the data columns for readability
    data_cols = [c for c in df.columns if c in set(cols) | {out_name}]
    return w._with(df=df.select(*data_cols, *[c for c in df.columns if c not in data_cols]))
