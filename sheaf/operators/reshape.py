"""Reshape verbs: wrap, fold/unfold, transpose, translate.

Output width is always bounded: verbs whose width depends on the data take
``max_columns`` / ``max_values`` / ``max_rows`` and raise above it (they never
drop or truncate rows).
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import PART, Wrangler, inner, outer
from ..functions.text import regex_found
from ..match import Regex
from ..plans.order import ordered_scan, shift_fits, sort_keys, tie_break
from .common import row_hit


def _check_width(n: int, limit: int, what: str) -> None:
    if n > limit:
        raise ValueError(f"{what} would give {n} columns (> {limit}); raise the limit to allow it")


# -- wrap --------------------------------------------------------------------

def wrap(w: Wrangler, n=None, where=None, columns=None, max_columns: int = 1000,
         width: int | None = None, as_array: bool = False, by: str = "column") -> Wrangler:
    """``wrap(n)``: W1 when ``n >= width`` (n rows -> one row) else W2 (each row's
    cells regrouped into n rows); ``wrap(where=regex)``: W3."""
    if (n is None) == (where is None):
        raise ValueError("give n= or where=")
    if where is not None:
        return wrap_where(w, where, columns, max_columns, width, as_array, by)
    if n < 1:
        raise ValueError("n must be >= 1")
    if n < len(w.cells):
        return wrap_cells(w, n)
    return wrap_rows(w, n, max_columns)


def wrap_rows(w: Wrangler, n: int, max_columns: int = 1000) -> Wrangler:
    """Every ``n`` consecutive rows become one row; cells in row-major order
    (r0c0, r0c1, r1c0, ...); a short last group is padded with ''."""
    if n < 1:
        raise ValueError("n must be >= 1")
    cols = w.cells
    _check_width(n * len(cols), max_columns, "wrap")
    df, rid, w2 = w._rid()
    g, k = w2.fresh("__g", extra=[rid]), w2.fresh("__k", extra=[rid])
    df = df.withColumn(g, F.floor(F.col(rid) / n).cast("long")).withColumn(k, F.col(rid) % n)
    out = gathered(df, [*w.part_cols, g], k, {c: w.text(c) for c in cols})
    cells = [F.expr(_cell(f"{ROWS}.`{c}`", j, f"c{j * len(cols) + m}")) for j in range(n) for m, c in enumerate(cols)]
    return Wrangler._raw(out.select(*w.part_cols, g, *cells), order=(g,), qkey=g, depth=w2.depth)


ROWS = "__rows"


def _cell(array: str, i: int, name: str) -> str:
    """SQL for one cell of a wide row: hundreds of these are quicker to state than to build. All
    names are spelled by ``inner``."""
    return f"coalesce(get({array}, {i}), '') AS `{name}`"


def gathered(df: DataFrame, by: list[str], pos: str, cells: dict[str, Column]) -> DataFrame:
    """One row per group with its cells as an array of structs in the order of ``pos``, in
    ``ROWS``. After an ordered scan the rows of a group lie together, so each task first joins its
    own, and mostly whole arrays are moved. Groups are of a size that the caller has bounded."""
    row = F.struct(F.col(pos).alias("__p"), *[e.alias(c) for c, e in cells.items()])
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias(ROWS))


def wrap_cells(w: Wrangler, n: int) -> Wrangler:
    """Row [a, b, c, d], n=2 -> rows [a, c], [b, d] (row-local, no shuffle)."""
    cols = w.cells
    if n < 1:
        raise ValueError("n must be >= 1")
    width = -(-len(cols) // n)
    sub = w.fresh("__sub")
    structs = []
    for j in range(n):
        cells = []
        for m in range(width):
            i = j + m * n
            cells.append((w.text(cols[i]) if i < len(cols) else F.lit("")).alias(f"c{m}"))
        structs.append(F.struct(*cells, F.lit(j).alias(sub)))
    keep = [c for c in w.df.columns if c not in cols]
    out = w.df.select(*keep, F.inline(F.array(*structs)))
    return w._with(df=out, order=w.order + (sub,) if w.order else ())


def wrap_where(w: Wrangler, where, columns=None, max_columns: int = 1000,
               width: int | None = None, as_array: bool = False,
               by: str = "column") -> Wrangler:
    """Read cells column by column (``by='row'``: row by row, the W4 row
    form); a cell matching regex ``where`` starts a new row; rows are padded to
    the longest (or to ``width``, which then must hold every row – a longer one
    raises). No blank first row."""
    w.require_batch("wrap(where=)")
    cols = w.resolve(columns)
    m, val = w.fresh("__m"), w.fresh("__v")
    keep = [c for c in w.df.columns if c not in w.cells]
    long = w.df.select(*keep, F.posexplode(F.array(*[w.text(c) for c in cols])).alias(m, val))
    if by not in ("column", "row"):
        raise ValueError("by must be 'column' or 'row'")
    # cells in column-major (the default) or row-major order
    order = (m,) + w.order if by == "column" else w.order + (m,)
    prefix = (m,) + w.prefix if by == "column" else w.prefix
    lw = Wrangler._raw(long, order=order, prefix=prefix, qkey=w.qkey,
                       bounds=w.bounds, prefix_unbounded=w.prefix_unbounded, depth=w.depth)
    rid, grp, start, pos = (lw.fresh("__lr"), lw.fresh("__grp"), lw.fresh("__start"),
                            lw.fresh("__pos"))
    if callable(where):  # W4: a predicate on the cell
        hit = where(F.col(val))
    else:
        hit = regex_found(F.col(val), where.pattern if isinstance(where, Regex) else where)
    hit = F.coalesce(hit, F.lit(False))
    df, lw2 = ordered_scan(lw, rid=rid, csum={grp: hit.cast("long")}, last_hit={start: hit})
    # position inside the group = rid - rid of the group's first cell
    df = df.withColumn(pos, F.col(rid) - F.coalesce(F.col(start), F.lit(0)))
    if width is None:
        # the longest row is found first, so only bounded groups are gathered
        longest = df.agg(F.max(pos).alias("w")).first()["w"]
        width = 1 if longest is None else longest + 1
        guarded = F.col(val)
    else:
        # no extra pass: a longer row fails the job instead of being cut
        guarded = F.when(F.col(pos) >= width, F.raise_error(F.lit(
            f"wrap(where=) found a row longer than width={width}")).cast("string")).otherwise(F.col(val))
    _check_width(width, max_columns, "wrap(where=)")
    out = gathered(df, [*w.part_cols, grp], pos, {val: guarded})
    if as_array:  # one array column instead of a wide row
        cells = [F.col(ROWS)[val].alias("cells")]
    else:
        cells = [F.expr(_cell(f"{ROWS}.{val}", j, f"c{j}")) for j in range(width)]
    return Wrangler._raw(out.select(*w.part_cols, grp, *cells), order=(grp,), qkey=grp, depth=lw2.depth)


# -- fold / unfold -------------------------------------------------------------

def fold(w: Wrangler, columns=None, rows=None, key: str = "key", value: str = "value",
         where: Callable[[Column], Column] | None = None, max_key_rows: int = 1000) -> Wrangler:
    """Unpivot ``columns`` into (key, value) rows; other columns repeat.

    Keys are the column names, or the cells of the header-like ``rows`` (or of
    the rows where ``where(first folded cell)`` holds); those rows are removed.
    """
    cols = w.resolve(columns)
    ids = [c for c in w.cells if c not in cols]
    key, value = inner(key), inner(value)
    k = w.fresh("__fk")
    key_rows: list[list[Column]] | None = None  # per key row, its cell for every folded column
    base, helpers = w, []
    if rows is not None or where is not None:
        w.require_batch("fold with key rows")
        base, helpers, key_rows = _key_rows(w, cols, rows, where, max_key_rows)
    if key_rows is None:
        keys, key_names = [[F.lit(outer(c))] for c in cols], [key]
    else:
        keys = [[r[j] for r in key_rows] for j in range(len(cols))]
        key_names = [key] if len(key_rows) == 1 else [inner(f"{outer(key)}_{i + 1}") for i in range(len(key_rows))]
    structs = [F.struct(*[kv.alias(kn) for kv, kn in zip(ks, key_names)],
                        base.text(c).alias(value), F.lit(i).alias(k))
               for i, (c, ks) in enumerate(zip(cols, keys))]
    keep = [c for c in base.df.columns if c not in cols and c not in helpers]
    out = base.df.select(*keep, F.inline(F.array(*structs)))
    out = out.select(*ids, *key_names, value, *[c for c in out.columns
                                                  if c not in ids + key_names + [value]])
    return base._with(df=out, order=base.order + (k,) if base.order else ())


def _key_rows(w: Wrangler, cols: list[str], rows, where, limit: int):
    """The table without its key rows, helper columns, and per key row the folded cells.

    Without a partition key these are at most ``limit`` literals. With one, every partition
    has its own key rows: the cells of its i-th are spread over the partition's rows by a
    forward and a backward fill (the plan of ``fill_row``), no list and no join on the key."""
    if rows is not None:
        w2, sel, helper = row_hit(w, rows)
    else:
        w2, sel, helper = w, F.coalesce(where(w.text(cols[0])), F.lit(False)), None
    drop = [helper] if helper else []
    if not w.has_part:
        found = w2.df.filter(sel)
        found = found.orderBy(*sort_keys(w)) if w.order else found.orderBy(*[w.text(c) for c in cols])
        got = found.select(*[w.text(c).alias(c) for c in cols]).limit(limit + 1).collect()
        if len(got) > limit:
            raise ValueError(f"more than {limit} key rows")
        base = w2._with(df=w2.df.filter(~sel).drop(*drop))
        return base, [], [[F.lit(r[c]) for c in cols] for r in got]
    if not w.order:
        raise ValueError("key rows per partition need a row order (order_by=)")
    hit, nth = w2.fresh("__hit"), w2.fresh("__nth")
    marked = w2._with(df=w2.df.withColumn(hit, sel))
    df, w3 = ordered_scan(marked, csum={nth: F.col(hit).cast("long")})
    top = df.agg(F.max(nth)).first()[0] or 0
    if top > limit:
        raise ValueError(f"more than {limit} key rows in a partition")
    w3 = w3._with(df=df)
    names, ahead, back = [], {}, {}
    for i in range(1, top + 1):
        for c in cols:
            f, b = (w3.fresh(f"__k{d}{len(names)}", extra=names) for d in "fb")
            names += [f, b]
            cell = F.when(F.col(hit) & (F.col(nth) == i), w.text(c))
            ahead[f], back[b] = cell, cell
    df, w4 = ordered_scan(w3, ffill=ahead, bfill=back)
    base = w4._with(df=df.filter(~F.col(hit)))
    cells = [F.coalesce(F.col(f), F.col(b)) for f, b in zip(ahead, back)]
    return base, [*drop, hit, nth, *names], [cells[i * len(cols):(i + 1) * len(cols)] for i in range(top)]


def unfold(w: Wrangler, column, measure, values: list | None = None,
           max_values: int = 1000) -> Wrangler:
    """Pivot – each distinct value of the key column(s) ``column`` becomes a column
    holding ``measure`` (the first in row order, '' if none); the other columns form the row
    key. A null key is the column ``null``; several key columns give names joined by ``_``."""
    keys = w.resolve(column)
    (meas,) = w.resolve(measure)
    rest = [c for c in w.cells if c not in keys and c != meas]
    if values is None:
        w.require_batch("unfold without values=")
        got = (w.df.select(*[w.text(c).alias(c) for c in keys]).distinct()
               .orderBy(*keys).limit(max_values + 1).collect())
        values = [tuple(r) for r in got]
    else:
        values = [v if isinstance(v, tuple) else (v,) for v in values]
    _check_width(len(values), max_values, "unfold")
    names = ["_".join("null" if x is None else str(x) for x in v) for v in values]
    if len(set(names)) != len(names) or {inner(n) for n in names} & set(rest):
        raise ValueError(f"unfold would give columns that are not unique: {names}")
    # the first cell of each (row key, value), then the cells of a row key by their places
    first_key, place, cell, got = (w.fresh(x) for x in ("__first", "__place", "__cell", "__got"))
    named = [w.fresh(f"__key{i}") for i in range(len(keys))]
    by = [*w.part_cols, *rest]
    if w.order:
        okey = F.struct(*[F.col(c) for c in w.order])
        aggs = [F.min_by(w.text(meas), okey).alias(cell), F.min(okey).alias(first_key)]
    else:
        aggs = [F.min(w.text(meas)).alias(cell)]
    one = w.df.groupBy(*by, *[w.text(k).alias(n) for k, n in zip(keys, named)]).agg(*aggs)
    # at most max_values rows, joined by a hash of all key columns
    listed = w.spark.createDataFrame([(*[None if x is None else str(x) for x in v], i) for i, v in enumerate(values)],
                                     ", ".join([*[f"{n}_ string" for n in named], f"{place} int"]))
    same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in named])
    one = one.join(F.broadcast(listed), same, "left")
    aggs = [F.sort_array(F.collect_list(F.when(F.col(place).isNotNull(), F.struct(F.col(place).alias("p"), F.col(cell).alias("v")))))
            .alias(got)]
    out = one.groupBy(*by).agg(*aggs, *([F.min(first_key).alias(first_key)] if w.order else []))

    def with_gaps(e: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col(got), i - 1)["p"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(""), e["p"] - before - 1), F.array(F.coalesce(e["v"], F.lit(""))))

    order = [f"__ord{i}" for i in range(len(w.order))]
    out = out.select(*by, F.flatten(F.transform(got, with_gaps)).alias(got),
                     *[F.col(first_key)[c].alias(o) for c, o in zip(w.order, order)])
    out = out.selectExpr(*[f"`{c}`" for c in by], *[_cell(got, i, inner(n)) for i, n in enumerate(names)], *order)
    return Wrangler._raw(out, order=tuple(order), qkey=order[0] if order else None, depth=w.depth)


def transpose(w: Wrangler, max_rows: int = 1000) -> Wrangler:
    """Rows <-> columns; the header is dropped (columns become c0..cN-1).
    The row count becomes the width, so it must be at most ``max_rows``."""
    w.require_batch("transpose")
    if w.has_part:
        raise ValueError("transpose works on one table: merge_parts() first")
    n = w.df.limit(max_rows + 1).count()
    _check_width(n, max_rows, "transpose")
    cols = w.cells
    df, rid, w2 = w._rid()
    m, val = w.fresh("__m", extra=[rid]), w.fresh("__v", extra=[rid])
    long = df.select(rid, F.posexplode(F.array(*[w.text(c) for c in cols])).alias(m, val))
    out = (long.groupBy(m).pivot(rid, list(range(n))).agg(F.first(val)))
    out = out.select(*[F.col(str(i)).alias(f"c{i}") for i in range(n)], m)
    return Wrangler._raw(out, order=(m,), qkey=m, depth=w2.depth)


def transpose_tiles(w: Wrangler, block_rows: int = 1000) -> Wrangler:
    """W8 in tiles, for a table of any length: ``(row, block, cells)`` holds the cells of the
    transposed row ``row`` from ``block * block_rows`` on, as an array of at most so many."""
    w.require_batch("transpose")
    if w.has_part:
        raise ValueError("transpose works on one table: merge_parts() first")
    if block_rows < 1:
        raise ValueError("block_rows must be >= 1")
    df, rid, w2 = w._rid()
    cells = F.array(*[w.text(c) for c in w.cells])
    # one tile of all columns is gathered, then taken apart, so a row is moved once
    block = F.floor(F.col(rid) / block_rows).cast("long").alias("block")
    out = gathered(df.select(block, rid, cells.alias("cells")), ["block"], rid, {"cells": F.col("cells")})
    tiles = F.transform(F.sequence(F.lit(0), F.lit(len(w.cells) - 1)), lambda m: F.transform(F.col(ROWS), lambda r: F.get(r["cells"], m)))
    out = out.select("block", F.posexplode(tiles).alias("row", "cells")).select("row", "block", "cells")
    return Wrangler._raw(out, order=("row", "block"), qkey="row", depth=w2.depth)


# -- translate -------------------------------------------------------------------

def translate_cols(w: Wrangler, distance: int, left: bool) -> Wrangler:
    """Add ``distance`` blank columns on the left or the right."""
    if distance < 0:
        raise ValueError("distance must be >= 0")
    blanks = [F.lit("").alias(w.fresh(f"blank{i}")) for i in range(distance)]
    data = [F.col(c) for c in w.cells]
    other = [F.col(c) for c in w.df.columns if c not in w.cells]
    sel = (blanks + data if left else data + blanks) + other
    return w._with(df=w.df.select(*sel))


def translate_rows(w: Wrangler, distance: int, top: bool) -> Wrangler:
    """Add ``distance`` blank rows first (``top``) or last (per ``_part``)."""
    w.require_batch("translate up/down")
    if distance < 0:
        raise ValueError("distance must be >= 0")
    if not w.order:
        raise ValueError("adding rows at an end needs a row order (order_by=)")
    t, ti = w.fresh("__t"), w.fresh("__ti")
    base = w.df.withColumn(t, F.lit(0)).withColumn(ti, F.lit(0))
    if w.has_part:
        src = w.df.select(PART).distinct()
    else:
        src = w.spark.range(1).select()
    blank = src.select(*[c for c in src.columns],
                       F.explode(F.sequence(F.lit(0), F.lit(distance - 1))).alias(ti)) \
        if distance > 0 else None
    if blank is None:
        return w
    dtypes = dict(w.df.dtypes)
    base = base.select(*[w.text(c).alias(c) if c in w.cells else F.col(c)
                         for c in base.columns])
    blank = blank.select(
        *[F.lit("").alias(c) for c in w.cells], *w.part_cols,
        *[F.lit(None).cast(dtypes[c]).alias(c) for c in w.df.columns
          if c not in w.cells and c != PART],
        F.lit(-1 if top else 1).alias(t), F.col(ti))
    out = base.unionByName(blank)
    return w._with(df=out, order=(t, ti) + w.order, prefix=(t,) + w.prefix)


def translate(w: Wrangler, column=None, direction: str = "down", distance: int = 1) -> Wrangler:
    """Shift whole columns. ``down``: ``distance`` blanks on top of the
    column(s), which become longer (other columns padded with ''); ``up``: the
    first ``distance`` cells go, blanks at the bottom. No column: all columns."""
    if direction not in ("down", "up"):
        raise ValueError("direction must be 'down' or 'up'")
    if distance < 0:
        raise ValueError("distance must be >= 0")
    if column is None:
        if direction == "down":
            return translate_rows(w, distance, top=True)
        cut = w.delete(rows=list(range(distance))) if distance > 0 else w
        return translate_rows(cut, distance, top=False)
    w.require_batch("translate")
    shifted = w.resolve(column)
    cols = w.cells
    if distance == 0:
        return w
    w, fits = shift_fits(w, distance)
    if fits:
        return _translate_near(w, shifted, distance if direction == "down" else -distance)
    df, rid, w2 = w._rid()
    pos, side = w2.fresh("__pos", extra=[rid]), w2.fresh("__side", extra=[rid])
    delta = distance if direction == "down" else -distance
    # one pass over the rows: every row emits its unshifted cells at its own
    # position and its shifted cells ``delta`` rows away; one regroup by
    # position puts them together (at most two records per position).
    def rec(at, moved):
        cells = [(w.text(c) if (c in shifted) == moved else F.lit(None).cast("string")).alias(c)
                 for c in cols]
        return F.struct(at.alias(pos), *cells, F.lit(moved).alias(side))

    recs = df.select(*w.part_cols, F.inline(F.array(rec(F.col(rid), False),
                                                    rec(F.col(rid) + delta, True))))
    if direction == "up":
        recs = recs.filter(F.col(pos) >= 0)
    out = recs.groupBy(*w.part_cols, pos).agg(
        *[F.coalesce(F.max(c), F.lit("")).alias(c) for c in cols],
        F.min(F.col(side).cast("int")).alias(side))
    if direction == "up":  # keep exactly the original positions
        out = out.filter(F.col(side) == 0)
    out = out.select(*cols, *w.part_cols, pos)
    return Wrangler._raw(out, order=(pos,), qkey=pos, depth=w2.depth)


def _translate_near(w: Wrangler, shifted: list[str], step: int) -> Wrangler:
    """W11 by ``step`` rows (down, or up if negative) with one exchange of the data. Down, the
    table grows by ``step`` rows: they hold the last cells of the shifted columns."""
    cols = w.cells
    w = w.select_cells({c: w.text(c) for c in cols})
    rid = w.fresh("__rid")
    outs = {w.fresh(f"__moved{i}"): c for i, c in enumerate(shifted)}
    df, w2 = ordered_scan(w, rid=rid, shift=(outs, step))
    new = {c: o for o, c in outs.items()}
    body = df.select(*[F.coalesce(new.get(c, c), F.lit("")).alias(c) for c in cols], rid)
    if step > 0:
        n = w.keys.count()
        down = [F.col(c).desc_nulls_last() for c in w.order]
        tie = [] if w.prefix_unbounded else [tie_break(w.df).desc()]
        last = w.df.orderBy(*down, *tie).limit(step)  # at most step rows, each task keeps as many
        last = last.select(*shifted, (F.lit(n + step) - F.row_number().over(Window.orderBy(*down, *tie))).cast("long").alias(rid))
        more = w.spark.range(n, n + step).toDF(rid).join(F.broadcast(last), rid, "left")
        body = body.unionByName(more.select(*[F.coalesce(c, F.lit("")).alias(c) if c in shifted else F.lit("").alias(c) for c in cols], rid))
    return Wrangler._raw(body, order=(rid,), qkey=rid, depth=w2.depth)
