"""Width discovery and padding.

Verbs that produce a data-dependent number of pieces build one array column
per source column, find the widest row with ONE small aggregate (``max(size)``
for all columns at once), then spread ``coalesce(get(arr, i), '')`` into
columns. The array is projected in its own ``select`` so the (possibly
expensive) split runs once per row, not once per output column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Wrangler, inner, outer


def _names(existing: list[str], base: str, n: int) -> list[str]:
    out = []
    taken = set(existing)
    for i in range(1, n + 1):
        name = f"{outer(base)}_{i}"
        while inner(name) in taken:
            name += "_"
        taken.add(inner(name))
        out.append(inner(name))
    return out


def expand(w: Wrangler, parts: dict[str, list[Column]]) -> Wrangler:
    """Replace each column ``c`` in ``parts`` by its (static) pieces ``c_1..c_n``."""
    sel = []
    made = []
    existing = list(w.df.columns)
    for c in w.df.columns:
        if c in parts:
            src = F.col(c)
            names = _names(existing, c, len(parts[c]))
            existing += names
            made += names
            sel += [F.when(src.isNull(), F.lit(None).cast("string")).otherwise(e).alias(n)
                    for e, n in zip(parts[c], names)]
        else:
            sel.append(F.col(c))
    out = w._with(df=w.df.select(*sel), same_rows=True)
    out.created = tuple(made)
    return out


def expand_in_steps(w: Wrangler, steps: dict) -> Wrangler:
    """``expand`` where the pieces are found step by step: ``steps[c]`` is a generator function
    of the cell that yields columns to be computed once and returns the pieces. Every step is a
    projection of its own, whose columns the next ones read."""
    tmp: list[str] = []
    df, running, pieces = w.df, {}, {}
    for c, make in steps.items():
        running[c] = (make(w.text(c)), None)
    while running:
        new, waiting = {}, {}
        for c, (gen, sent) in running.items():
            try:
                value = gen.send(sent)
            except StopIteration as done:
                pieces[c] = done.value
                continue
            name = w.fresh(f"__step{len(tmp)}", extra=tmp)
            tmp.append(name)
            new[name] = value
            waiting[c] = (gen, F.col(name))
        if new:
            df = df.withColumns(new)
        running = waiting
    wide = w._with(df=df, same_rows=True)
    out = expand(wide, {c: pieces[c] for c in steps})
    res = out._with(df=out.df.drop(*tmp), same_rows=True)
    res.created = out.created
    return res


def split_within(c: Column, pattern: str, width: int):
    """(pieces of ``c`` up to ``width``, test that a cell has more). One ``split`` a cell: its
    last piece holds what lies beyond the width, which may only be delimiters, since trailing
    empty pieces do not count."""
    def too_long(a: Column) -> Column:
        beyond = F.get(a, width)
        return beyond.isNotNull() & ~beyond.rlike("^(?:" + pattern + ")*\\z")

    return F.split(c, pattern, width + 1), too_long


def spread(w: Wrangler, arrays: dict[str, Column], width: int | dict | None = None,
           max_columns: int = 1000, too_long=None) -> Wrangler:
    """Replace each column ``c`` in ``arrays`` by ``c_1..c_W`` padded with ''.

    ``width`` given -> no aggregate (works on streams); else one eager
    ``max(size(arr))`` over all the arrays together.
    """
    tmp = {c: w.fresh(f"__arr{i}") for i, c in enumerate(arrays)}
    df1 = w.df.select(*[arrays[c].alias(tmp[c]) if c in arrays else F.col(c)
                        for c in w.df.columns])
    if width is None or isinstance(width, dict):
        given = width or {}
        todo = [c for c in arrays if c not in given]
        widths = dict(given)
        if todo:
            if w.is_streaming:
                raise ValueError("data-dependent width on a stream: pass width=")
            row = df1.agg(*[F.max(F.size(tmp[c])).alias(tmp[c]) for c in todo]).first()
            for c in todo:
                v = row[tmp[c]] if row is not None else None
                widths[c] = max(1, int(v) if v is not None and v > 0 else 1)
    else:
        widths = {c: width for c in arrays}
    for c, n in widths.items():
        if n > max_columns:
            raise ValueError(
                f"column {outer(c)!r} would become {n} columns (> max_columns={max_columns})")
    if too_long is not None:
        # a row that does not fit the given width fails the job; nothing is dropped. The check
        # reads the arrays that the projection below it has made.
        df1 = df1.select(*[F.when(too_long(F.col(x)), F.raise_error(F.lit(
            f"more than width={width} pieces"))).otherwise(F.col(x)).alias(x)
            if x in tmp.values() else F.col(x) for x in df1.columns])
    names, cells, existing = {}, [], list(df1.columns)
    for c in arrays:
        a = F.col(tmp[c])
        names[c] = _names(existing, c, widths[c])
        existing += names[c]
        cells += [F.when(a.isNotNull(), F.coalesce(F.get(a, i), F.lit(""))).alias(n) for i, n in enumerate(names[c])]
    # a generator of one row: a later filter on a piece would be pushed below a projection, and
    # compute the whole split once more for each time it looks at the piece
    keep = [c for c in w.df.columns if c not in arrays]
    wide = df1.select(*keep, F.inline(F.array(F.struct(*cells))))
    out = w._with(df=wide.select(*[n for c in w.df.columns for n in names.get(c, [c])]), same_rows=True)
    out.created = tuple(n for c in w.df.columns for n in names.get(c, []))
    out.lean = w.keys
    return out
