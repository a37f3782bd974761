"""cut: remove text from cells.

Every form compiles to one Catalyst expression per column; specs given as a
list are folded in C14 order into a single expression tree.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Wrangler
from ..functions import text as T
from ..match import (AFTER, ON, Regex, Spec, as_pattern, check_max, is_pattern, make_specs,
                     order_specs)
from .common import map_cells


# -- position helpers (0-based, null when absent) ----------------------------

def start_of(c: Column, t) -> Column:
    if isinstance(t, int):
        return F.lit(t)
    if isinstance(t, str):
        p = F.instr(c, t)
        return F.when(p > 0, p - 1)
    return T.regex_prefix_len(c, t.pattern)


def end_of(c: Column, t) -> Column:
    if isinstance(t, int):
        return F.lit(t + 1)
    if isinstance(t, str):
        p = F.instr(c, t)
        return F.when(p > 0, p - 1 + len(t))
    return T.regex_through_len(c, t.pattern)


def range_bounds(c: Column, a, b, where: str) -> tuple[Column, Column]:
    """(first, second) offsets of a range: ``on`` covers a..b inclusive,
    ``between`` the text strictly inside. An Int ``b`` counts from ``first``;
    a pattern ``b`` is searched from ``first``."""
    first = start_of(c, a) if where == ON else end_of(c, a)
    tail = T.rest(c, first + 1)
    if isinstance(b, int):
        second = first + (b + 1 if where == ON else b)
    else:
        second = first + (end_of(tail, b) if where == ON else start_of(tail, b))
    return first, second


def _valid(c: Column, first: Column, second: Column) -> Column:
    return (first.isNotNull() & second.isNotNull() & (first >= 0) & (second > first)
            & (second <= F.length(c)))


def cut_range(c: Column, a, b, where: str, max: str) -> Column:
    if is_pattern(a) and is_pattern(b):
        A, B = as_pattern(a), as_pattern(b)
        if max == "all":
            pat, _ = T.range_pattern(A, B, where == ON)
            return F.regexp_replace(c, F.lit(pat), F.lit("" if where == ON else "$1"))
        if where == ON:
            return T.first_regex_removed(c, T.range_pattern(A, B, True)[0])
        found, _, post = T.first_match(c, A)
        hit, gap, _ = T.first_match(post, B)
        kept = F.concat(T.head(c, F.length(c) - F.length(post)), T.rest(post, F.length(gap) + 1))
        return F.when(found & hit, kept).otherwise(c)
    # positional ends: first range only (a fixed position does not repeat)
    first, second = range_bounds(c, a, b, where)
    return F.when(_valid(c, first, second), T.remove_range(c, first, second)).otherwise(c)


def cut_one(c: Column, spec: Spec, max: str) -> Column:
    t, where = spec.target, spec.where
    if isinstance(t, tuple):
        return cut_range(c, t[0], t[1], where, max)
    if isinstance(t, int):
        if where == ON:
            return T.delete_char(c, t)
        if where == AFTER:  # keep the first t characters
            return F.when(F.length(c) > t, T.head(c, t)).otherwise(c)
        return F.when(F.length(c) > t, T.rest(c, t + 1)).otherwise(F.when(c.isNotNull(), F.lit("")))
    if isinstance(t, str):
        if where == ON:
            return F.replace(c, F.lit(t), F.lit("")) if max == "all" else T.remove_first_literal(c, t)
        p = F.instr(c, t)
        if where == AFTER:
            return F.when(p > 0, T.head(c, p + len(t) - 1)).otherwise(c)
        return F.when(p > 0, T.rest(c, p)).otherwise(c)
    assert isinstance(t, Regex)
    if where == ON:
        if max == "all":
            return T.all_regex_removed(c, t.pattern)
        return T.first_regex_removed(c, t.pattern)
    if where == AFTER:
        return T.keep_through_regex(c, t.pattern)
    return T.keep_from_regex(c, t.pattern)


def cut_expr(specs: list[Spec], max: str) -> Callable[[Column], Column]:
    ordered = order_specs(specs)

    def f(c: Column) -> Column:
        for s in ordered:
            c = cut_one(c, s, max)
        return c

    return f


def cut(w: Wrangler, on=None, after=None, before=None, between=None, columns=None,
        max: str = "first", row=None) -> Wrangler:
    """C7-C16 (+C15 with ``row``): the rich cut. Strings are literals,
    ``re_(...)`` regexes, ints positions, tuples ranges."""
    specs = make_specs(on=on, after=after, before=before, between=between)
    check_max(specs, max)
    return map_cells(w, columns, cut_expr(specs, max), rows=row)


def cut_index(w: Wrangler, index: int, columns=None) -> Wrangler:
    """Remove the character at ``index``."""
    if index < 0:
        raise ValueError(f"negative index {index}")
    return map_cells(w, columns, lambda c: T.delete_char(c, index))


def cut_regex(w: Wrangler, pattern: str, columns=None) -> Wrangler:
    """Remove the first match of regex ``pattern``."""
    return map_cells(w, columns, lambda c: T.first_regex_removed(c, pattern))


def cut_fn(w: Wrangler, fn: Callable[[Column], Column], columns=None) -> Wrangler:
    """Remove the first occurrence of ``fn(cell)``; null / absent -> unchanged."""

    def f(c: Column) -> Column:
        r = fn(c)
        p = F.instr(c, r)
        return F.when(p > 0, F.concat(T.head(c, p - 1), T.rest(c, p + F.length(r)))).otherwise(c)

    return map_cells(w, columns, f)


def cut_all(w: Wrangler, value: str, columns=None) -> Wrangler:
    """C4: remove every literal occurrence of ``value``."""
    return map_cells(w, columns, lambda c: F.replace(c, F.lit(value), F.lit("")))


def cut_right(w: Wrangler, value: str, columns=None) -> Wrangler:
    """Remove the last literal occurrence of ``value``."""
    return map_cells(w, columns, lambda c: T.remove_last_literal(c, value))


def cut_before(w: Wrangler, index: int, columns=None, inclusive: bool = False) -> Wrangler:
    """Drop the first ``index`` characters. A cell no longer than ``index``
    is kept; with ``inclusive=True`` a cell of exactly ``index`` becomes ""."""
    if index < 0:
        raise ValueError(f"negative index {index}")

    def f(c: Column) -> Column:
        cond = F.length(c) >= index if inclusive else F.length(c) > index
        return F.when(cond, T.rest(c, index + 1)).otherwise(c)

    return map_cells(w, columns, f)


def edit(w: Wrangler, fn=None, value=None, columns=None, rows=None) -> Wrangler:
    """C18 (``fn``) / C19 (constant ``value``, optionally only in ``rows``)."""
    if (fn is None) == (value is None):
        raise ValueError("give exactly one of fn= or value=")
    f = fn if fn is not None else (lambda c: F.lit(value))
    return map_cells(w, columns, f, rows=rows)
