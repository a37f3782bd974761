"""split and extract: one cell becomes several columns.

Two-way forms have a static width of 2 (no aggregate, row-local, streamable).
``max='all'`` and lists of specs build an array per cell and discover the
width with one small aggregate (``plans.width``).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Wrangler
from ..functions import text as T
from ..match import AFTER, BEFORE, ON, Spec, as_pattern, is_pattern, make_specs, order_specs
from ..plans.width import expand, expand_in_steps, split_within, spread
from .cut import _valid, range_bounds


def E() -> Column:
    return F.lit("")


# -- SW-style two-way forms ------------------------------------------------

def split_index(w: Wrangler, index: int, columns=None) -> Wrangler:
    """(before, after) with the character at ``index`` dropped."""
    if index < 0:
        raise ValueError(f"negative index {index}")

    def parts(c):
        ok = F.length(c) > index
        return [F.when(ok, T.head(c, index)).otherwise(c),
                F.when(ok, T.rest(c, index + 2)).otherwise(E())]

    return expand(w, {n: parts(w.text(n)) for n in w.resolve(columns)})


def _split_at(c: Column, p: Column, length) -> list[Column]:
    ok = p > 0
    return [F.when(ok, T.head(c, p - 1)).otherwise(c),
            F.when(ok, T.rest(c, p + length)).otherwise(E())]


def split_value(w: Wrangler, value: str, columns=None) -> Wrangler:
    """Split at the first literal ``value`` (dropped); absent -> (cell, '')."""
    return expand(w, {n: _split_at(w.text(n), F.instr(w.text(n), value), len(value))
                      for n in w.resolve(columns)})


def split_fn(w: Wrangler, fn: Callable[[Column], Column], columns=None) -> Wrangler:
    """Split at the first occurrence of ``fn(cell)``."""
    out = {}
    for n in w.resolve(columns):
        c = w.text(n)
        r = fn(c)
        out[n] = _split_at(c, F.coalesce(F.instr(c, r), F.lit(0)), F.length(r))
    return expand(w, out)


def split_right(w: Wrangler, value: str, columns=None) -> Wrangler:
    """Split at the last literal ``value``."""
    return expand(w, {n: _split_at(w.text(n), T.last_index1(w.text(n), value), len(value))
                      for n in w.resolve(columns)})


def split_all(w: Wrangler, pattern: str, columns=None, width: int | None = None,
              max_columns: int = 1000) -> Wrangler:
    """P5: split at every match of regex ``pattern`` (JVM split semantics),
    padded to the widest row. With ``width`` no aggregate runs; a cell of more
    than ``width`` pieces then fails the job."""
    names = w.resolve(columns)
    if width is not None:
        if width < 1:
            raise ValueError("width must be >= 1")
        cut = {n: split_within(w.text(n), pattern, width) for n in names}
        return spread(w, {n: a for n, (a, _) in cut.items()}, width=width, max_columns=max_columns,
                      too_long=next(iter(cut.values()))[1])
    arrays = {n: T.jvm_split(w.text(n), pattern) for n in names}
    return spread(w, arrays, max_columns=max_columns)


# -- OW-style spec forms -----------------------------------------------------

def _locate(c: Column, t):
    """Steps to (found, text before, text after) of the first match of a literal or regex."""
    found = yield from (T.locate(c, t, None) if isinstance(t, str) else T.locate(c, None, t.pattern))
    return found


def _first_range(c: Column, a, b, where: str):
    """Steps to (found, left, right, middle) of the first range. ``on`` takes its ends with it;
    ``between`` leaves them, and looks at the first ``a`` only: with no ``b`` behind it, or right
    behind it, the cell has no range."""
    if not (is_pattern(a) and is_pattern(b)):
        first, second = range_bounds(c, a, b, where)
        ends = yield F.struct(first.alias("first"), second.alias("second"))
        first, second = ends["first"], ends["second"]
        return (F.coalesce(_valid(c, first, second), F.lit(False)), T.head(c, first), T.rest(c, second + 1),
                F.substr(c, first + 1, second - first))
    if where == ON and not (isinstance(a, str) and isinstance(b, str)):
        pat, _ = T.range_pattern(as_pattern(a), as_pattern(b), True)
        found, left, right = yield from T.locate(c, None, pat)
        return found, left, right, F.substr(c, F.length(left) + 1, F.length(c) - F.length(left) - F.length(right))
    if where == ON:  # literals: the end is searched from the start of the first match
        p = yield F.instr(c, a)
        q = yield F.when(p > 0, F.instr(T.rest(c, p), b)).otherwise(F.lit(0))
        return q > 0, T.head(c, p - 1), T.rest(c, p + q - 1 + len(b)), F.substr(c, p, q - 1 + len(b))
    found, _, post = yield from _locate(c, a)
    post = yield F.when(found, post).otherwise(F.lit(""))
    hit, gap, _ = yield from _locate(post, b)
    gap = yield F.when(hit, gap).otherwise(F.lit(""))
    return (gap != F.lit(""), T.head(c, F.length(c) - F.length(post)), T.rest(post, F.length(gap) + 1), gap)


def _first(c: Column, spec: Spec):
    """Steps to (found, left, right, middle) of a first-mode spec; ``middle`` is what an ``on``
    match or a range holds."""
    t, where = spec.target, spec.where
    if isinstance(t, int):
        ok = F.length(c) > t
        left = T.head(c, t + 1) if where == AFTER else T.head(c, t)
        right = T.rest(c, t + 1) if where == BEFORE else T.rest(c, t + 2)
        return ok, left, right, F.substr(c, F.lit(t + 1), F.lit(1))
    if isinstance(t, tuple):
        found = yield from _first_range(c, t[0], t[1], where)
        return found
    ok, pre, post = yield from _locate(c, t)
    if where == ON:
        size = F.length(c) - F.length(pre) - F.length(post)
        return ok, pre, post, F.substr(c, F.length(pre) + 1, size)
    if where == AFTER:
        return ok, T.head(c, F.length(c) - F.length(post)), post, E()
    return ok, pre, T.rest(c, F.length(pre) + 1), E()


def _split_pieces(spec: Spec, max: str):
    """Steps from a piece to the array of its pieces."""
    t, where = spec.target, spec.where
    ranged = isinstance(t, tuple)
    if max == "all" and not isinstance(t, int) and (not ranged or all(map(is_pattern, t))):
        if not ranged:
            of = {ON: T.jvm_split, AFTER: T.pieces_after, BEFORE: T.pieces_before}[where]
            return lambda p: of(p, as_pattern(t))
        pat, _ = T.range_pattern(as_pattern(t[0]), as_pattern(t[1]), where == ON)
        if where == ON:
            return lambda p: T.jvm_split(p, pat)
        # the text of each start stays at the end of the piece before its range
        return lambda p: F.zip_with(F.split(p, pat, -1), F.regexp_extract_all(p, F.lit(pat), F.lit(1)),
                                    lambda x, m: F.concat(x, F.coalesce(m, E())))

    def steps(p: Column):
        ok, left, right, _ = yield from _first(p, spec)
        return F.when(ok, F.array(left, right)).otherwise(F.array(p))

    return lambda p: T.in_steps(steps, p)


def _compose(fns: list[Callable[[Column], Column]]) -> Callable[[Column], Column]:
    def f(c: Column) -> Column:
        arr = F.array(c)
        for fn in fns:
            arr = F.flatten(F.transform(arr, fn))
        return F.when(c.isNotNull(), arr)

    return f


def split(w: Wrangler, on=None, after=None, before=None, between=None, columns=None,
          max: str = "first", max_columns: int = 1000) -> Wrangler:
    """P6-P11. One spec in ``first`` mode -> always two columns (cell, '' when
    absent). Lists / ``all`` -> pieces in C14 order, padded to the widest row."""
    if max not in ("first", "all"):
        raise ValueError("max must be 'first' or 'all'")
    specs = order_specs(make_specs(on=on, after=after, before=before, between=between))
    names = w.resolve(columns)
    if len(specs) == 1 and max == "first":
        def steps(c: Column):
            ok, left, right, _ = yield from _first(c, specs[0])
            return [F.when(ok, left).otherwise(c), F.when(ok, right).otherwise(E())]

        return expand_in_steps(w, dict.fromkeys(names, steps))
    fn = _compose([_split_pieces(s, max) for s in specs])
    return spread(w, {n: fn(w.text(n)) for n in names}, max_columns=max_columns)


# -- extract -------------------------------------------------------------------

def extract_index(w: Wrangler, index: int, columns=None) -> Wrangler:
    """(cell, character at ``index`` or '')."""
    if index < 0:
        raise ValueError(f"negative index {index}")
    return expand(w, {n: [w.text(n), F.when(F.length(w.text(n)) > index,
                                            F.substr(w.text(n), F.lit(index + 1), F.lit(1)))
                          .otherwise(E())] for n in w.resolve(columns)})


def extract_value(w: Wrangler, value: str, columns=None) -> Wrangler:
    """(cell, ``value`` if it occurs else '')."""
    return expand(w, {n: [w.text(n), F.when(F.instr(w.text(n), value) > 0, F.lit(value))
                          .otherwise(E())] for n in w.resolve(columns)})


def extract_fn(w: Wrangler, fn: Callable[[Column], Column], columns=None) -> Wrangler:
    """(cell, ``fn(cell)`` if it occurs in the cell else '')."""
    out = {}
    for n in w.resolve(columns):
        c = w.text(n)
        r = fn(c)
        out[n] = [c, F.when(F.coalesce(F.instr(c, r), F.lit(0)) > 0, r).otherwise(E())]
    return expand(w, out)


def _extract_pieces(spec: Spec, max: str):
    """Steps from a piece to the array of the piece without its matches, and the matches."""
    t, where = spec.target, spec.where
    ranged = isinstance(t, tuple)
    if max == "all" and not isinstance(t, int) and (not ranged or all(map(is_pattern, t))):
        pat, group = T.range_pattern(as_pattern(t[0]), as_pattern(t[1]), where == ON) if ranged else (as_pattern(t), 0)
        left = F.lit("$1" if group else "")
        return lambda p: F.concat(F.array(F.regexp_replace(p, F.lit(pat), left)),
                                  F.regexp_extract_all(p, F.lit(pat), F.lit(group)))

    def steps(p: Column):
        ok, left, right, middle = yield from _first(p, spec)
        return F.when(ok, F.array(F.concat(left, right), middle)).otherwise(F.array(p))

    return lambda p: T.in_steps(steps, p)


def extract(w: Wrangler, on=None, between=None, after=None, before=None, columns=None,
            max: str = "first", max_columns: int = 1000) -> Wrangler:
    """(cell without the match, match). ``all``: the cell without every
    match, then one column per match."""
    if max not in ("first", "all"):
        raise ValueError("max must be 'first' or 'all'")
    if (after is None) != (before is None):
        raise ValueError("extract supports on= and between= (or after= with before=) only")
    specs = order_specs(make_specs(on=on, after=after, before=before, between=between))
    names = w.resolve(columns)
    if len(specs) == 1 and max == "first":
        def steps(c: Column):
            ok, left, right, middle = yield from _first(c, specs[0])
            return [F.when(ok, F.concat(left, right)).otherwise(c), F.when(ok, middle).otherwise(E())]

        return expand_in_steps(w, dict.fromkeys(names, steps))
    fn = _compose([_extract_pieces(s, max) for s in specs])
    return spread(w, {n: fn(w.text(n)) for n in names}, max_columns=max_columns)
