"""Secrets in texts: base rules, and character Markov models for strings that no rule names.

The base rules find key-value assignments, access keys and long hexadecimal runs. Beyond
them, every run of at least ``MIN_RUN`` key characters that no base span touches is judged by
two kinds of first-order Markov models over its characters: one for each alphabet of random
strings (``KINDS``) and one for ordinary identifiers, words, paths and numbers. The score is
the largest log-likelihood ratio of a random kind against the ordinary one; it is accepted
above the log odds of ``PRIOR``, the share of runs taken to be secrets.

The models are counted from labelled strings. Random ones: the values of base spans, by
their alphabet, and ``MADE`` strings of each kind made from SHA-512 digests. Ordinary ones: the
other runs of sampled texts, these runs joined as identifiers are (snake, kebab, camel, path,
numbered), and numbers. The texts are those whose hash is smallest, about ``SAMPLE`` different
ones whatever the size of the table; all texts are scanned whole.

All of it is DataFrame functions: matches are found by regular expressions, their places are
running sums of the lengths between them (in blocks, so that many matches cost no more than
their number), and whether a run touches a base span is a binary search in the sorted spans.

Nulls and special cases: a null text is empty; every row gives one row, also repeated ones
and ones with a null id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, pick

#: The base rules, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
BASE = ("assign", "access", "hex")
RANDOM = "random"

ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
SYMBOLS = len(ALPHABET) + 1  # and the start
KINDS = ("hex", "upper", "alnum", "base64")
MIN_RUN = 16
RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"
SAMPLE, MADE = 500, 1000
PRIOR = 1e-4
#: Weight of the counted model against the uniform one.
TRUST = 0.95
BLOCK = 256
EMPTY = "array<struct<s:bigint,e:bigint,m:string>>"


# -- places of matches -------------------------------------------------------

def bound(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once: inside a lambda an expression is computed anew
    for every element, a lambda's variable is not."""
    return F.get(F.transform(F.array(value), fn), 0)


def running_sum(a: Column) -> Column:
    """Running sums of an array of long, block by block."""
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def sums(values: Column, start: Column) -> Column:
        return F.slice(F.aggregate(values, F.array(start), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))), 2, 1 << 30)

    def total(block: Column) -> Column:
        return F.aggregate(block, zero, lambda s, x: s + x)

    def by_block(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, total), zero)
        return F.flatten(F.zip_with(blocks, ends, lambda b, e: sums(b, e - total(b))))

    def cut(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))

    return F.when(F.size(a) == 0, empty).otherwise(bound(bound(a, cut), by_block))


def located(text: Column, pattern: str) -> Column:
    """All matches as array<struct<s, e, m>>: places in code points, end exclusive, and text."""
    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found,
                           lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        return F.zip_with(running_sum(steps), found, lambda e, m: F.struct(
            (e - F.length(m)).cast("long").alias("s"), e.alias("e"), m.alias("m")))

    return (F.when(text.rlike(pattern), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed))
            .otherwise(F.array().cast(EMPTY)))


def base_spans(text: Column) -> list[Column]:
    """The spans of the three base kinds, each sorted and without overlaps."""
    value = lambda z: F.length(F.regexp_extract(z["m"], ASSIGN, 2)) >= 6
    return [F.filter(located(text, ASSIGN), value), located(text, ACCESS), located(text, HEX)]


def touched(spans: Column, s: Column, e: Column) -> Column:
    """Does [s, e) overlap one of the sorted spans? By binary search for the last that begins
    before ``e``."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def step(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        before = (at["lo"] < at["hi"]) & (F.get(spans, mid)["s"] < e)
        return F.struct(F.when(before, mid + 1).otherwise(at["lo"]).alias("lo"),
                        F.when(before | (at["lo"] >= at["hi"]), at["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), step, lambda at: at["lo"])
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(F.coalesce(F.get(spans, found - 1)["e"] > s, F.lit(False)))


# -- models ------------------------------------------------------------------

def code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def pairs(s: Column) -> Column:
    """The character pairs of a string as numbers ``before * SYMBOLS + after``; 0 is the start."""
    chars = F.split(s, "")
    both = F.zip_with(F.concat(F.array(F.lit("")), chars), chars, lambda a, b: F.when(
        b.isNotNull(), F.when(a == "", 0).otherwise(code(a)) * SYMBOLS + code(b)))
    return F.filter(both, lambda p: p.isNotNull())


def kind_of(s: Column) -> Column:
    return (F.when(s.rlike("^[0-9a-f]+$"), "hex").when(s.rlike("^[A-Z0-9]+$"), "upper")
            .when(s.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64"))


def made_strings(spark, n: int = MADE, salt: str = "sheaf") -> DataFrame:
    """``(kind, s)``: ``n`` random strings of each kind, and as many numbers as ordinary ones."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512)
    size = F.lit(MIN_RUN) + F.pmod(F.col("id"), F.lit(49))
    base64 = F.base64(F.unhex(digest))
    alnum = F.regexp_replace(base64, "[+/=\r\n]", "")
    rows = [("hex", digest), ("upper", F.upper(alnum)), ("alnum", alnum), ("base64", F.regexp_replace(base64, "[=\r\n]", ""))]
    cut = [F.struct(F.lit(k).alias("kind"), F.substr(s, F.lit(1), size.cast("int")).alias("s")) for k, s in rows]
    number = F.struct(F.lit("ordinary").alias("kind"), F.conv(F.substr(digest, F.lit(1), F.lit(14)), 16, 10).alias("s"))
    return spark.range(n).select(F.inline(F.array(*cut, number)))


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(kind, s)``: labelled strings of about ``sample`` different texts of ``docs`` (``text``)."""
    n = docs.count()
    d = docs.select(F.coalesce("text", F.lit("")).alias("t"))
    if n > sample:
        grain = 1 << 40
        d = d.where(F.pmod(F.xxhash64("t"), F.lit(grain)) < F.lit(grain * sample // n))
    d = d.distinct()  # copies share a hash: they come once
    spans = base_spans(F.col("t"))
    values = F.concat(F.transform(spans[0], lambda z: F.regexp_extract(z["m"], ASSIGN, 2)),
                      *[F.transform(a, lambda z: z["m"]) for a in spans[1:]])
    secret = d.select(F.explode(values).alias("s")).select(kind_of(F.col("s")).alias("kind"), F.translate("s", ".", "").alias("s"))
    clean = F.col("t")
    for p in (ASSIGN, ACCESS, HEX):
        clean = F.regexp_replace(clean, p, " ")
    runs = d.select(F.filter(F.split(clean, "[^A-Za-z0-9+/_=-]+"), lambda w: w != "").alias("w"))

    def joined(w: Column, i: Column) -> Column:
        after = F.coalesce(F.get(F.col("w"), i + 1), F.lit("id"))
        forms = [F.concat(w, F.lit("_"), after), F.concat(w, F.lit("-"), after), F.concat(F.lower(w), F.initcap(after)),
                 F.concat(F.lit("/"), w, F.lit("/"), after), F.concat(w, i.cast("string")), F.concat(w, after),
                 F.concat(F.upper(w), F.lit("_"), F.upper(after))]
        return F.get(F.array(w, *forms), F.pmod(i, F.lit(len(forms) + 1)))

    plain = runs.select(F.explode(F.transform("w", joined)).alias("s")).select(F.lit("ordinary").alias("kind"), "s")
    return secret.unionAll(plain)


def fit(strings: DataFrame) -> list[list[float]]:
    """For each of ``KINDS`` the log-likelihood ratios of all pairs. ``strings``: (kind, s). A
    character that repeats is never taken as a sign of randomness."""
    counted = (strings.select("kind", F.explode(pairs(F.col("s"))).alias("pair")).groupBy("kind", "pair")
               .agg(F.count(F.lit(1)).alias("n")).collect())  # at most (kinds + 1) * SYMBOLS^2 rows
    counts = {(r["kind"], r["pair"]): r["n"] for r in counted}
    logs = {}
    for kind in (*KINDS, "ordinary"):
        for a in range(SYMBOLS):
            row = [counts.get((kind, a * SYMBOLS + b), 0) for b in range(SYMBOLS)]
            total, even = sum(row), 1 / (SYMBOLS - 1)
            logs[kind, a] = [math.log(TRUST * n / total + (1 - TRUST) * even if total else even) for n in row]
    return [[min(0.0, r - o) if a == b else r - o for a in range(SYMBOLS)
             for b, (r, o) in enumerate(zip(logs[kind, a], logs["ordinary", a], strict=True))] for kind in KINDS]


def score(s: Column, weights: list[list[float]]) -> Column:
    """The largest log-likelihood ratio of a random kind against the ordinary model."""
    flat = F.split(F.lit(",".join(f"{w:.6f}" for row in weights for w in row)), ",").cast("array<double>")  # folded once
    size = SYMBOLS * SYMBOLS
    start = F.struct(F.lit(0).alias("before"), *[F.lit(0.0).alias(k) for k in KINDS])

    def step(t: Column, c: Column) -> Column:
        at = t["before"] * SYMBOLS + code(c)
        return F.struct(code(c).alias("before"), *[(t[k] + F.get(flat, at + i * size)).alias(k) for i, k in enumerate(KINDS)])

    return F.aggregate(F.split(s, ""), start, step, lambda t: F.greatest(*[t[k] for k in KINDS]))


# -- the scan ----------------------------------------------------------------

def scan(docs: DataFrame, weights: list[list[float]], text: str = "text", prior: float = PRIOR, min_run: int = MIN_RUN) -> DataFrame:
    """Adds ``assign``, ``access``, ``hex`` and ``random``: arrays of (s, e, m), sorted, to every
    row; columns of these names in ``docs`` give way."""
    t = F.coalesce(col(text), F.lit(""))
    limit = math.log((1 - prior) / prior)
    keep = [col(c) for c in docs.columns if c.lower() not in (*BASE, RANDOM, "__runs")]
    first = docs.select(*keep, *[a.alias(k) for a, k in zip(base_spans(t), BASE, strict=True)],
                        F.filter(located(t, RUN % min_run), lambda z: score(z["m"], weights) >= limit).alias("__runs"))
    free = F.filter("__runs", lambda z: ~(touched(F.col(BASE[0]), z["s"], z["e"]) | touched(F.col(BASE[1]), z["s"], z["e"])
                                          | touched(F.col(BASE[2]), z["s"], z["e"])))
    return first.select("*", free.alias(RANDOM)).drop("__runs")


def as_text(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans by start, then kind as listed, joined by commas."""
    def tag(i: int):
        return lambda z: F.struct(z["s"].alias("s"), F.lit(i).alias("k"), z["e"].alias("e"))

    tagged = [F.transform(F.col(k), tag(i)) for i, k in enumerate(kinds)]
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(F.concat(*tagged)), lambda z: F.concat_ws(
        ":", F.get(name, z["k"]), z["s"].cast("string"), z["e"].cast("string"))), ",")


def train(docs: DataFrame, sample: int = SAMPLE) -> list[list[float]]:
    """The weights for a table with a ``text`` column."""
    return fit(labelled(docs, sample).unionAll(made_strings(docs.sparkSession)))


def op13(docs: DataFrame) -> DataFrame:
    d = pick(docs, doc_id="doc_id", text="text")
    found = scan(d, train(d))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(as_text(BASE).cast("binary"), 256).alias("base_sha256"), as_text((*BASE, RANDOM)).alias("spans"))
