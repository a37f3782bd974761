"""Personal data by weak supervision.

Labelers (format rule, checksum, gazetteer, left context, surroundings) vote on every
candidate span. Expectation-maximisation over the counts of vote patterns, taken from the
whole corpus, estimates how reliable each labeler is and so how likely each pattern is
personal data; a logistic span classifier is then trained on those likelihoods with
features of the span, and decides which candidates beyond the base rules are spans.
What reaches the driver are counts of patterns: their number is bounded by the votes and
feature values (kinds x 3^5 x 8 x 3 x 2), whatever the corpus.

Base spans (a format that passes its check) always stay. Nulls and special cases: a null
text counts as empty; repeated rows and null ids stay rows of their own.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

KINDS = ["email", "ip", "card", "phone"]

# Base formats (fixed values).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# Looser formats, which only propose candidates.
HIDDEN_MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]{2,63}){1,4}")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
DIGIT = re.compile(r"[0-9]")

# Gazetteers and cue words (fixed values).
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es it uk eu us ch at nl be pl example".split())
CALLING = ("+1", "+33", "+34", "+44", "+49", "+39", "+41", "+43", "+31", "+32", "+48", "+7", "+81", "+86", "+91")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|62")
CUES = {
    "email": re.compile(r"e-?mail|contact|write|correo|courriel|kontakt", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|adresse|login", re.I),
    "card": re.compile(r"card|visa|master|credit|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|handy|llam|appel", re.I),
}
LABELERS = ["format", "checksum", "gazetteer", "context", "surroundings"]
CONTEXT_CHARS = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches of ``local@label(.label)+``. The part before an @ is
    the run of its characters on the left, so each character is looked at once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        end = m.end() if m else at + 1
        at = text.find("@", end)


def ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def card_ok(s: str) -> bool:
    d = digits_of(s)
    return 12 <= len(d) <= 19 and luhn(d)


def phone_ok(s: str) -> bool:
    return 9 <= len(digits_of(s)) <= 15


def matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and further candidates of a text, as ``(start, end, kind)``."""
    base, more = [], []
    if "@" in text:
        base += [(a, b, 0) for a, b in emails(text)]
    if DIGIT.search(text):
        for kind, pattern, ok in ((1, IP, ip_ok), (2, CARD, card_ok), (3, PHONE, phone_ok)):
            if kind == 3 and "+" not in text:
                continue
            for m in pattern.finditer(text):
                if ok(m[0]):
                    base.append((m.start(), m.end(), kind))
                elif kind != 2 or m.end() - m.start() >= 12:  # shorter runs of digits are plain numbers
                    more.append((m.start(), m.end(), kind))
        more += [(m.start(), m.end(), 3) for m in LOCAL_PHONE.finditer(text)]
    if "at" in text and ("[at" in text or "(at" in text or "{at" in text):
        more += [(m.start(), m.end(), 0) for m in HIDDEN_MAIL.finditer(text)]
    base.sort()
    if more:  # candidates give way to base spans and to earlier candidates
        starts, reach, free, end = [a for a, _, _ in base], [0], [], 0
        for _, b, _ in base:
            reach.append(max(reach[-1], b))  # furthest end of the base spans up to here
        for a, b, k in sorted(more, key=lambda s: (s[0], -s[1])):
            if a >= end and reach[bisect_left(starts, b)] <= a:
                free.append((a, b, k))
                end = b
        more = free
    return base, more


def votes(text: str, start: int, end: int, kind: int, is_base: bool) -> tuple[int, ...]:
    """One vote a labeler: 1 for personal data, -1 against, 0 none."""
    s, name = text[start:end], KINDS[kind]
    d = digits_of(s)
    if kind == 0:
        check = 1 if is_base or "at" in s else -1
        gaz = 1 if re.split(r"[^A-Za-z0-9]+", s.rstrip("])}"))[-1].lower() in TOP_DOMAINS else 0
    elif kind == 1:
        parts = s.split(".")
        check = 1 if ip_ok(s) and not any(len(p) > 1 and p[0] == "0" for p in parts) else -1
        gaz = -1 if parts[0].lstrip("0") in ("", "127", "255") or len(parts[0]) > 3 else 0
    elif kind == 2:
        check = 1 if 12 <= len(d) <= 19 and luhn(d) else -1
        gaz = 1 if ISSUERS.match(d) else -1
    else:
        check = 1 if 9 <= len(d) <= 15 else -1
        gaz = 1 if s.startswith(CALLING) or len(d) == 10 else 0
    left, right = text[max(0, start - CONTEXT_CHARS) : start], text[end : end + 1]
    if CUES[name].search(left):
        context = 1
    else:
        context = -1 if re.search(r"[=\"'#$/\\]\s*$", left) else 0
    glued = (left[-1:].isalnum() or left[-1:] in "_-.") and bool(left) or right.isalnum() or right in ("_", '"', "=")
    return (1 if is_base else -1, check, gaz, context, -1 if glued else 1)


def shape(text: str, start: int, end: int) -> tuple[int, int, int]:
    """Span features with few values: length class, share of digits, separators."""
    s = text[start:end]
    n = sum("0" <= c <= "9" for c in s)
    return min((end - start) // 4, 7), min(3 * n // len(s), 2), int(any(c in " -()" for c in s))


def code(v: tuple[int, ...], f: tuple[int, int, int], kind: int) -> int:
    """Votes, features and kind as one small number."""
    c = 0
    for x in v:
        c = 3 * c + x + 1
    return (((c * 8 + f[0]) * 3 + f[1]) * 2 + f[2]) * 4 + kind


def decode_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back to kinds, votes (n x labelers) and features (n x 3)."""
    c, kind = np.divmod(codes, 4)
    c, f2 = np.divmod(c, 2)
    c, f1 = np.divmod(c, 3)
    c, f0 = np.divmod(c, 8)
    v = np.empty((len(codes), len(LABELERS)), np.int64)
    for j in range(len(LABELERS) - 1, -1, -1):
        c, r = np.divmod(c, 3)
        v[:, j] = r - 1
    return kind, v, np.stack([f0, f1, f2], 1)


def expectation_maximisation(v: np.ndarray, kind: np.ndarray, n: np.ndarray, rounds: int = 200,
                             prior: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Per pattern (votes ``v``, ``kind``, count ``n``) the probability of personal data,
    and each labeler's estimated vote table ``[class, labeler, vote]``. Labelers are taken to
    err independently given the truth; classes are anchored by a prior that a vote is more
    often right than wrong."""
    anchor = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])  # pseudo-votes -1, 0, 1 by class
    p = 1 / (1 + np.exp(-1.5 * v.sum(1)))
    table = np.zeros((2, v.shape[1], 3))
    for _ in range(rounds):
        old = p
        score = np.zeros((2, len(n)))
        for y in (0, 1):
            weight = n * (p if y else 1 - p)
            for j in range(v.shape[1]):
                table[y, j] = np.bincount(v[:, j] + 1, weight, 3) + prior * anchor[y]
            table[y] /= table[y].sum(1, keepdims=True)
            score[y] = np.log(table[y, np.arange(v.shape[1]), v + 1]).sum(1)
            share = (np.bincount(kind, weight, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2)
            score[y] += np.log(share[kind])
        p = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(p - old).max(initial=0) < 1e-9:
            break
    return p, table


def design(kind: np.ndarray, v: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Features of the span classifier: a constant, kind, votes by kind, length, digits, separators."""
    one = np.eye(len(KINDS))[kind]
    return np.concatenate([np.ones((len(kind), 1)), one, (one[:, :, None] * v[:, None, :]).reshape(len(kind), len(KINDS) * len(LABELERS)),
                           np.eye(8)[f[:, 0]], np.eye(3)[f[:, 1]], f[:, 2:3]], 1)


#: What the counts of all patterns together weigh against the ridge term, whatever the size of the table.
WEIGHT = 10_000


def train_classifier(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft labels ``p`` of patterns counted ``n`` times (Newton steps).
    Patterns weigh by their share of the whole count."""
    w = np.zeros(x.shape[1])
    n = n * (WEIGHT / n.sum()) if len(n) else n
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - q)) - ridge * w
        hess = (x * (n * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        base_rows, more_rows = [], []
        for t in b.column(1).to_pylist():
            base, more = matches(t) if t else ([], [])
            make = lambda spans, is_base, t=t: [
                {"s": s, "e": e, "k": k, "c": code(votes(t, s, e, k, is_base), shape(t, s, e), k)} for s, e, k in spans]
            base_rows.append(make(base, True))
            more_rows.append(make(more, False))
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.int32()), ("c", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base_rows, kind), pa.array(more_rows, kind)],
                                         names=["id", "base", "more"])


_SPANS = "array<struct<s:bigint,e:bigint,k:int,c:bigint>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, base spans and further candidates, each with its pattern code."""
    d = pick(docs, id=id_col, text=text_col)
    return d.mapInArrow(_scan, f"id {d.schema['id'].dataType.simpleString()}, base {_SPANS}, more {_SPANS}")


def fit(found: DataFrame, threshold: float = 0.5) -> dict:
    """Learns from a table of candidates. Returns the patterns that the classifier accepts,
    the labelers' estimated vote tables and the classifier's weights."""
    counts = (found.select(F.explode(F.concat("base", "more")).alias("x")).groupBy(F.col("x.c").alias("c"))
              .agg(F.count(F.lit(1)).alias("n")).orderBy("c").collect())
    codes, n = np.array([r.c for r in counts], np.int64), np.array([r.n for r in counts], np.float64)
    kind, v, f = decode_codes(codes)
    p, table = expectation_maximisation(v, kind, n)
    x = design(kind, v, f)
    w = train_classifier(x, p, n)
    q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {"accepted": frozenset(codes[q >= threshold].tolist()), "reliability": table, "weights": w}


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def _digest(batches, accepted: frozenset) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for base, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            own = [(x["s"], x["e"], x["k"]) for x in base]
            added = [(x["s"], x["e"], x["k"]) for x in more if x["c"] in accepted]
            n = np.bincount([k for *_, k in own], minlength=len(KINDS)).tolist() if own else [0] * len(KINDS)
            rows.append((*n, hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(own + added), len(added)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                                         names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])


def op2(docs: DataFrame) -> DataFrame:
    """The counts and the digest are of base spans; ``spans`` holds all."""
    found = stored(candidates(docs))
    accepted = fit(found)["accepted"]
    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(lambda it: _digest(it, accepted),
                            f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                            "base_sha256 string, spans string, n_added bigint")


def redact_text(text: str | None, accepted: frozenset) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are one."""
    if not text:
        return text
    base, more = matches(text)
    spans = base + [(s, e, k) for s, e, k in more if code(votes(text, s, e, k, False), shape(text, s, e), k) in accepted]
    out, at = [], 0
    for s, e, k in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def _redacted(batches, at: int, accepted: frozenset) -> Iterator[pa.RecordBatch]:
    for b in batches:
        new = pa.array([redact_text(t, accepted) for t in b.column(at).to_pylist()], b.schema.field(at).type)
        yield pa.RecordBatch.from_arrays([*b.columns[:at], new, *b.columns[at + 1 :]], names=b.schema.names)


def redact(docs: DataFrame, accepted: frozenset, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with personal data in the text column masked."""
    at = docs.columns.index(text_col)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    ddl = ", ".join(f"`{n}` {t}" for n, t in inner.dtypes)
    return inner.mapInArrow(lambda it: _redacted(it, at, accepted), ddl).toDF(*docs.columns)
