"""Match specifications for ``cut`` / ``split`` / ``extract``.

A target is one of

* ``int``      – a 0-based position,
* ``str``      – a literal,
* ``Regex``    – a Java regular expression (``re_("...")``),
* ``(a, b)``   – a range whose ends are any of the above.

A spec pairs a target with where it applies: ``on`` (the match itself),
``after`` / ``before`` (keep / cut around the match) or ``between`` (strictly
inside a range).  All checks happen here, at plan-build time (C16), so a bad
spec never reaches an executor.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from itertools import product
from typing import Any

from .functions.text import quote_regex


@dataclass(frozen=True)
class Regex:
    pattern: str


def re_(pattern: str) -> Regex:
    return Regex(pattern)


ON, AFTER, BEFORE, BETWEEN = "on", "after", "before", "between"


@dataclass(frozen=True)
class Spec:
    target: Any
    where: str


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, list):
        return list(x)
    return [x]


def _check_target(t) -> None:
    if isinstance(t, bool):
        raise ValueError(f"unsupported match target {t!r}")
    if isinstance(t, int):
        if t < 0:
            raise ValueError(f"negative position {t}")
        return
    if isinstance(t, (str, Regex)):
        return
    if isinstance(t, tuple) and len(t) == 2:
        for end in t:
            if isinstance(end, tuple):
                raise ValueError("nested ranges are not supported")
            if isinstance(end, int) and not isinstance(end, bool):
                continue
            if not isinstance(end, (str, Regex)):
                raise ValueError(f"unsupported range end {end!r}")
        return
    raise ValueError(f"unsupported match target {t!r}")


def make_specs(on=None, after=None, before=None, between=None) -> list[Spec]:
    """The rules that the arguments describe, checked. Both an ``after`` and a ``before`` ask
    for what lies between any of the one and any of the other."""
    rules = {ON: _as_list(on), BETWEEN: _as_list(between), AFTER: _as_list(after), BEFORE: _as_list(before)}
    if after is not None and before is not None:
        rules[BETWEEN] += list(product(rules.pop(AFTER), rules.pop(BEFORE)))
    specs = [Spec(t, where) for where, targets in rules.items() for t in targets]
    if not specs:
        raise ValueError("no match rule given")
    for s in specs:
        _check_spec(s)
    if len(set(specs)) < len(specs):
        warnings.warn(f"duplicate match rules: {specs}")
    return specs


def _check_spec(s: Spec) -> None:
    is_range = isinstance(s.target, tuple)
    if is_range and s.where in (AFTER, BEFORE):
        raise ValueError("a range cannot be used with after/before alone")
    if s.where == BETWEEN and not is_range:
        raise ValueError("between needs a (start, end) pair")
    if s.where == BETWEEN and s.target[0] == -1:
        return  # "from the start of the cell"
    _check_target(s.target)


def position(s: Spec) -> int | None:
    """The last fixed position that a rule names, if any."""
    ends = s.target if isinstance(s.target, tuple) else (s.target,)
    fixed = [e for e in ends if isinstance(e, int)]
    return fixed[-1] if fixed else None


def order_specs(specs: list[Spec]) -> list[Spec]:
    """C14: the rules as they apply. Rules with positions come first, from the back of the
    cell to its front, so that each still finds the text it was given for; the others follow,
    the last listed first. Equal positions also apply the last listed first."""
    turned = specs[::-1]
    at = {s: position(s) for s in specs}
    placed = [s for s in turned if at[s] is not None and at[s] >= 0]
    other = [s for s in turned if at[s] is None or at[s] < 0]
    return sorted(placed, key=position, reverse=True) + other


def check_max(specs: list[Spec], max: str) -> None:
    if max not in ("first", "all"):
        raise ValueError(f"max must be 'first' or 'all', not {max!r}")
    if max == "all":
        for s in specs:
            if s.where in (AFTER, BEFORE):
                raise ValueError("max='all' cannot be used with after/before")


def as_pattern(t) -> str:
    """Regex source for a literal or Regex target."""
    if isinstance(t, Regex):
        return t.pattern
    if isinstance(t, str):
        return quote_regex(t)
    raise TypeError(t)


def is_pattern(t) -> bool:
    return isinstance(t, (str, Regex))
