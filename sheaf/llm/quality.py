"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements and one
failure bit per rule. Policies are versioned lists of rule names: applying one is a
bitwise *and* with its mask, and ``ablations`` (what would each rule's removal keep?)
is an aggregate over the few distinct bit patterns, never a second pass over texts.

Nulls and special cases: a null text counts as empty (it fails ``few_words``); rows with
null or repeated ids stay rows of their own; columns of the input beyond the id and the
text are carried by ``apply_policy`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, pick

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "top_word"]
_MEASURE_TYPE = pa.struct([(m, pa.int64()) for m in MEASURES])
MEASURE_DDL = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"

#: Rule name -> condition that fails a document, over the measurements. The position in
#: this list is the rule's bit for good: append new rules, never reorder.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    ("one_word", "n_words >= 20 and 2 * top_word > n_words"),
]
POLICIES: dict[str, list[str]] = {
    "base-1": ["few_words", "repeated_windows"],
    "full-1": [name for name, _ in RULES],
}
PRODUCTION = "full-1"


def repeated_words(ids: np.ndarray, n_distinct: int, window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs at least twice. Windows are
    compared exactly: a window is a number in base ``n_distinct``, ranked again before it
    could pass 63 bits."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, size = ids[:n].astype(np.int64), max(n_distinct, 2)
    top = size
    for k in range(1, window):
        if top > (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = n
        key = key * size + ids[k : k + n]
        top *= size
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str | None) -> tuple:
    """The measurements of one text, in the order of ``MEASURES``."""
    text = text or ""
    words = text.encode().split()  # bytes split at ASCII white space only
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines: set[str] = set()
    n_lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            n_lines += 1
            lines.add(line)
    return (len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)),
            n_lines, n_lines - len(lines), repeated_words(ids, len(seen)),
            int(np.bincount(ids).max()) if len(ids) else 0)


def _measured(batches: Iterator[pa.RecordBatch], text_at: int, name: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = list(zip(*map(measure, b.column(text_at).to_pylist()), strict=True)) or [[]] * len(MEASURES)
        s = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in rows], fields=list(_MEASURE_TYPE))
        yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, name])


def with_measures(df: DataFrame, text: str, out: str) -> DataFrame:
    """All columns of ``df`` and a struct ``out`` of the measurements of column ``text``."""
    at = df.columns.index(text)
    # positions instead of names on the way through Python: names may differ by case only
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    ddl = ", ".join(f"`{n}` {t}" for n, t in inner.dtypes) + f", m {MEASURE_DDL}"
    return inner.mapInArrow(lambda it: _measured(it, at, "m"), ddl).toDF(*df.columns, out)


def failure_bits(measures: str) -> Column:
    """One bit per rule of ``RULES`` over the struct column ``measures``."""
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        e = condition
        for m in MEASURES:
            e = _named(e, m, f"`{measures}`.{m}")
        bits = bits.bitwiseOR(F.when(F.expr(e), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def _named(expr: str, name: str, full: str) -> str:
    import re

    return re.sub(rf"(?<![\w`.]){name}\b", full, expr)


def mask(policy: list[str]) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in dict.fromkeys(policy))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, every measurement, ``failure_bits``."""
    m = with_measures(pick(docs, id=id_col, text=text_col), "text", "m").drop("text")
    return m.select(F.col("id").alias(id_col), "m.*", failure_bits("m").alias("failure_bits"))


def verdict(bits: Column, policy: list[str]) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: list[str], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns as they are."""
    name = fresh(docs, "measures")
    m = with_measures(docs, text_col, name)
    return m.where(verdict(failure_bits(name), policy)).select(*[col(c) for c in docs.columns])


def ablations(ledger_df: DataFrame, policy: list[str]) -> DataFrame:
    """Per rule of the policy: documents failing it, documents failing only it (kept once
    the rule is dropped) and documents kept by the whole policy. One aggregate to the
    distinct bit patterns (at most 2^rules rows), then sums over those."""
    names = [n for n, _ in RULES]
    m = mask(policy)
    masked = F.col("failure_bits").bitwiseAND(F.lit(m).cast("long"))
    patterns = ledger_df.groupBy(masked.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
                                for r in dict.fromkeys(policy)])).alias("r")
    zero = F.lit(0).cast("long")
    return (patterns.select("p", "n", rules).groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("p").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(zero)).alias("failing"),
                 F.sum(F.when(F.col("p") == F.col("r.bit"), F.col("n")).otherwise(zero)).alias("failing_only"),
                 F.sum(F.when(F.col("p") == 0, F.col("n")).otherwise(zero)).alias("kept")))


def op7(docs: DataFrame, policy: list[str] | None = None) -> DataFrame:
    led = ledger(docs)
    base = ~verdict(F.col("failure_bits"), POLICIES["base-1"])
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"),
                      (~base & verdict(F.col("failure_bits"), policy or POLICIES[PRODUCTION])).alias("kept"),
                      "failure_bits", "n_lines", "top_word")


def oracle_sql(policy: list[str] | None = None) -> str:
    """The same rows in DuckDB SQL over the view ``documents``."""
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, (_, c) in enumerate(RULES))
    base, full = mask(POLICIES["base-1"]), mask(policy or POLICIES[PRODUCTION])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS ls FROM d),
grams AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM
        (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest(range({WINDOW})) AS k FROM twice) GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(ws) AS x FROM w) GROUP BY r, x) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x09-\x0D\x20]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
        CAST(len(ls) AS BIGINT) AS n_lines, coalesce(top.n, 0) AS top_word
      FROM w LEFT JOIN covered USING (r) LEFT JOIN top USING (r)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & {base}) <> 0 AS base_failed,
  (failure_bits & {base | full}) = 0 AS kept, failure_bits, n_lines, top_word FROM b
"""
