"""Column -> Column string helpers.

Every helper here is a pure Catalyst expression (no Python at run time), so the
verbs built from them stay inside whole-stage codegen and also work inside
higher-order lambdas (``transform``) and on streaming frames.

Positions follow the Spark convention of the function used: ``instr``,
``substr``, ``length`` count code points; we never mix them with
``regexp_instr`` (UTF-16 units).
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCT = set(string.punctuation) | {" ", "\t"}


def quote_regex(value: str) -> str:
    """Escape ``value`` so that a Java regex matches it literally.

    ASCII punctuation is backslash-escaped (always legal in Java regex);
    letters and digits are left alone (``\\1`` would be a back-reference).
    """
    return "".join("\\" + ch if ch in _PUNCT else ch for ch in value)


def rest(c: Column, start1) -> Column:
    """Substring from 1-based ``start1`` (Column or int, must be >= 1) to the end."""
    return F.substr(c, start1 if isinstance(start1, Column) else F.lit(start1))


def head(c: Column, n) -> Column:
    """First ``n`` code points (``n`` Column or int, >= 0)."""
    return F.substr(c, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def remove_range(c: Column, start0: Column, end0: Column) -> Column:
    """``c[:start0] + c[end0:]`` with 0-based code-point offsets."""
    return F.concat(head(c, start0), rest(c, end0 + 1))


_REGEX_META = set("\\^$.|?*+()[]{}")


def plain_literal(pattern: str) -> str | None:
    """The pattern itself when it contains no regex metacharacter (then it
    matches exactly its own text), else None."""
    if pattern and not (set(pattern) & _REGEX_META):
        return pattern
    return None


def group_count(pattern: str) -> int:
    """Capture groups of ``pattern``."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", plain))


def shift_groups(pattern: str, by: int) -> str:
    """``pattern`` with the numbers of its back-references raised, for use behind ``by`` groups."""
    def one(m: re.Match) -> str:
        return "\\" + str(int(m[1]) + by) if m[1].isdigit() and m[1] != "0" else m[0]
    return re.sub(r"\\([1-9]|.)", one, pattern, flags=re.S) if by else pattern


def _consumes(pattern: str) -> bool:
    """True when every match certainly has at least one character."""
    try:
        from re import _parser

        return _parser.parse(pattern).getwidth()[0] > 0
    except Exception:  # noqa: BLE001 - Java-only syntax: not certain
        return False


def bound(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once. Inside a lambda an expression is computed anew
    for every element, and in ``when`` branches for every use; a lambda's variable is not."""
    return F.get(F.transform(F.array(value), fn), 0)


def in_steps(steps, x: Column) -> Column:
    """Run a stepwise computation (a generator function that yields columns to be computed once
    and returns a column) as one expression, for use inside lambdas."""
    gen = steps(x)

    def go(sent):
        try:
            value = gen.send(sent)
        except StopIteration as done:
            return done.value
        return bound(value, go)

    return go(None)


def first_match(c: Column, pattern: str) -> tuple[Column, Column, Column]:
    """(found, text before, text after) of the first match, from one ``split(c, P, 2)``: the
    user's pattern stays whole, so the numbers of its groups and back-references do too."""
    return _around(c, pattern, F.split(c, pattern, 2))


def _around(c: Column, pattern: str, parts: Column) -> tuple[Column, Column, Column]:
    """A ``split`` passes over an empty match at the start; unless the pattern always consumes
    something, that case is asked for."""
    found, pre, post = F.size(parts) == 2, F.get(parts, 0), F.get(parts, 1)
    if _consumes(pattern):
        return found, pre, post
    empty = F.regexp_extract(c, "^(?:" + pattern + ")", 0) == F.lit("")
    at_start = c.rlike("^(?:" + pattern + ")") & empty
    return at_start | found, F.when(at_start, F.lit("")).otherwise(pre), F.when(at_start, c).otherwise(post)


def locate(c: Column, value: str | None, pattern: str | None):
    """Steps to (found, text before, text after) of the first literal or regex match."""
    if value is not None:
        p = yield F.instr(c, value)
        return p > 0, head(c, p - 1), rest(c, p + len(value))
    parts = yield F.split(c, pattern, 2)
    return _around(c, pattern, parts)


def range_pattern(a: str, b: str, inclusive: bool) -> tuple[str, int]:
    """(regex of one range, number of the group that holds the text between its ends).

    Ranges are found as a reader would from left to right: the first place where ``a`` matches
    and a later ``b`` ends the range; then on behind it. With its ends (``inclusive``), ``b`` is
    searched from the start of ``a`` and may overlap it. Without them, ``b`` is searched behind
    the whole match of ``a`` (which is not shortened to make room), at least one character lies
    between, and group 1 holds the text of ``a``; ``b`` stays for the next range to begin with."""
    n = group_count(a)
    if inclusive:
        return f"(?=(?:{a}))(?s:.*?)(?:{shift_groups(b, n)})", 0
    gap = n + group_count(b) + 2
    return (f"((?>{shift_groups(a, 1)}))(?!(?:{shift_groups(b, n + 1)}))((?s:.+?))(?=(?:{shift_groups(b, gap)}))", gap)


def first_regex_removed(c: Column, pattern: str) -> Column:
    """Remove the first match of ``pattern`` (Java ``replaceFirst(p, "")``)."""
    lit = plain_literal(pattern)
    if lit is not None:
        return remove_first_literal(c, lit)
    found, pre, post = first_match(c, pattern)
    return F.when(found, F.concat(pre, post)).otherwise(c)


def regex_found(c: Column, pattern: str) -> Column:
    """``c`` contains a match of ``pattern`` (``rlike`` is a find)."""
    lit = plain_literal(pattern)
    return F.instr(c, lit) > 0 if lit is not None else c.rlike(pattern)


def all_regex_removed(c: Column, pattern: str) -> Column:
    lit = plain_literal(pattern)
    if lit is not None:
        return F.replace(c, F.lit(lit), F.lit(""))
    return F.regexp_replace(c, F.lit(pattern), F.lit(""))


def keep_through_regex(c: Column, pattern: str) -> Column:
    """Keep text up to and including the first match; unchanged if none."""
    found, _, post = first_match(c, pattern)
    return F.when(found, head(c, F.length(c) - F.length(post))).otherwise(c)


def keep_from_regex(c: Column, pattern: str) -> Column:
    """Keep text from the start of the first match; unchanged if none."""
    found, pre, _ = first_match(c, pattern)
    return F.when(found, rest(c, F.length(pre) + 1)).otherwise(c)


def last_index1(c: Column, value: str) -> Column:
    """1-based position of the last occurrence of literal ``value``; 0 if absent."""
    if value == "":
        return F.length(c) + 1
    after_last = F.substring_index(c, value, -1)
    return F.when(
        F.instr(c, value) > 0, F.length(c) - F.length(after_last) - F.lit(len(value)) + 1
    ).otherwise(F.lit(0))


def delete_char(c: Column, index0: int) -> Column:
    """Remove the code point at 0-based ``index0``; out of range -> unchanged."""
    return F.when(
        F.length(c) > index0, F.concat(head(c, index0), rest(c, index0 + 2))
    ).otherwise(c)


def remove_first_literal(c: Column, value: str) -> Column:
    if value == "":
        return c
    p = F.instr(c, value)
    return F.when(p > 0, F.concat(head(c, p - 1), rest(c, p + len(value)))).otherwise(c)


def remove_last_literal(c: Column, value: str) -> Column:
    if value == "":
        return c
    p = last_index1(c, value)
    return F.when(p > 0, F.concat(head(c, p - 1), rest(c, p + len(value)))).otherwise(c)


def jvm_split(c: Column, pattern: str) -> Column:
    """Array of pieces with JVM ``String.split(pattern)`` semantics.

    Spark's ``split`` keeps trailing empty strings; the JVM call drops them,
    and maps ``""`` to ``[""]``. ``","`` therefore gives ``[]``.
    """
    single = _single_char(pattern)
    if single is not None:
        # one-character delimiter: matches cannot overlap, so trailing empty
        # pieces are exactly trailing delimiters – strip them (codegen'd)
        stripped = F.regexp_replace(c, F.lit("(?:" + pattern + ")+\\z"), F.lit(""))
        return (F.when(c == F.lit(""), F.array(F.lit("")))
                .when(stripped == F.lit(""), F.array().cast("array<string>"))
                .otherwise(F.split(stripped, pattern, -1)))
    def no_tail(arr: Column) -> Column:
        last_non_empty = F.array_max(F.transform(arr, lambda y, i: F.when(y != F.lit(""), i + 1).otherwise(F.lit(0))))
        return F.slice(arr, F.lit(1), F.greatest(F.lit(0), last_non_empty))

    return F.when(c == F.lit(""), F.array(F.lit(""))).otherwise(bound(F.split(c, pattern, -1), no_tail))


def _single_char(pattern: str) -> str | None:
    """The literal character a regex stands for, if it is exactly one."""
    if len(pattern) == 1 and pattern not in "\\^$.|?*+()[]{}":
        return pattern
    if len(pattern) == 2 and pattern[0] == "\\" and not pattern[1].isalnum():
        return pattern[1]
    return None


def regex_prefix_len(c: Column, pattern: str) -> Column:
    """Code points before the first match of ``pattern``; null if no match."""
    found, pre, _ = first_match(c, pattern)
    return F.when(found, F.length(pre))


def regex_through_len(c: Column, pattern: str) -> Column:
    """Code points up to the end of the first match of ``pattern``; null if none."""
    found, _, post = first_match(c, pattern)
    return F.when(found, F.length(c) - F.length(post))


def pieces_after(c: Column, pattern: str) -> Column:
    """The text cut behind every match of ``pattern``; no trailing empty piece."""
    cut = F.zip_with(F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)),
                     lambda x, m: F.concat(x, F.coalesce(m, F.lit(""))))
    tail = lambda v: F.when((F.element_at(v, -1) == F.lit("")) & (F.size(v) > 1), F.slice(v, F.lit(1), F.size(v) - 1)).otherwise(v)
    return F.when(c == F.lit(""), F.array(F.lit(""))).otherwise(bound(cut, tail))


def pieces_before(c: Column, pattern: str) -> Column:
    """The text cut in front of every match of ``pattern``; no leading empty piece."""
    found = F.concat(F.array(F.lit("")), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    cut = F.zip_with(F.split(c, pattern, -1), found, lambda x, m: F.concat(m, x))
    lead = lambda v: F.when((F.get(v, 0) == F.lit("")) & (F.size(v) > 1), F.slice(v, F.lit(2), F.size(v) - 1)).otherwise(v)
    return bound(cut, lead)


def blank(c: Column) -> Column:
    """Null or empty string (R3: fills treat both as blank)."""
    return c.isNull() | (c == F.lit(""))
