"""Text sources.

Cells are strings; a blank is '' (never null). The row order of a file is
kept in three hidden columns: file path, split start and a per-partition
monotonically increasing id. A split is read by exactly one task, in file
order, so (path, split) doubles as the bucket of the ordered verbs – no
quantile pass is needed for text sources.
"""

from __future__ import annotations

import re
from pathlib import PurePosixPath
from re import _parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import HIDDEN, Wrangler, quoted
from ..functions.text import jvm_split
from ..match import Regex
from ..operators.reshape import ROWS, gathered
from ..plans.order import ordered_scan
from ..plans.width import split_within, spread

FILE, BLOCK, POS = f"{HIDDEN}file", f"{HIDDEN}block", f"{HIDDEN}pos"


def read_lines(spark: SparkSession, path, rows: str | Regex = "\n") -> Wrangler:
    """One cell per line; ``rows`` is a literal line separator, or a regex (``re_(...)``,
    see ``records``)."""
    if isinstance(rows, Regex):
        return records(_lines(spark.read.option("lineSep", "\n"), path), rows.pattern)
    return _lines(spark.read if rows == "\n" else spark.read.option("lineSep", rows), path)


def _lines(reader, path) -> Wrangler:
    df = reader.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(POS),
    )
    return Wrangler._raw(df, order=(FILE, BLOCK, POS), prefix=(FILE, BLOCK), qkey=None,
                         prefix_unbounded=True, dense=True)


def _holds_break(node) -> bool:
    """May a match of the parsed regex hold a line break?"""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return arg == 10
    if name == "NOT_LITERAL":
        return arg != 10
    if name == "IN":
        negated = bool(arg) and str(arg[0][0]) == "NEGATE"
        found = False
        for kind, value in arg:
            kind = str(kind)
            found |= (kind == "LITERAL" and value == 10) or (kind == "RANGE" and value[0] <= 10 <= value[1]) or (
                kind == "CATEGORY" and str(value) in ("CATEGORY_SPACE", "CATEGORY_NOT_DIGIT", "CATEGORY_NOT_WORD"))
        return found != negated
    if name == "BRANCH":
        return any(_holds_break(n) for branch in arg[1] for n in branch)
    if name == "SUBPATTERN":
        return any(_holds_break(n) for n in arg[-1])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        return any(_holds_break(n) for n in arg[2])
    if name == "ATOMIC_GROUP":
        return any(_holds_break(n) for n in arg)
    if name == "ANY":
        return False
    raise ValueError("a row separator cannot hold look-around, anchors or back-references")


def _break_is_last(nodes) -> bool:
    """Is a line break in a match always its last character?"""
    nodes = list(nodes)
    for i, (op, arg) in enumerate(nodes):
        name = str(op)
        if not _holds_break((op, arg)):
            continue
        if any(True for _ in nodes[i + 1:]):
            return False
        if name == "BRANCH" and not all(_break_is_last(b) for b in arg[1]):
            return False
        if name == "SUBPATTERN" and not _break_is_last(arg[-1]):
            return False
        if name == "ATOMIC_GROUP" and not _break_is_last(arg):
            return False
        if name.endswith("REPEAT") and (arg[1] > 1 or not _break_is_last(arg[2])):
            return False
    return True


def _check_separator(pattern: str) -> bool:
    """Raises for a regex that cannot separate rows line by line; True if a line break alone
    separates rows."""
    try:
        parsed = _parser.parse(pattern)
    except re.error as e:
        raise ValueError(f"row separator {pattern!r}: {e}") from None
    if parsed.getwidth()[0] < 1:
        raise ValueError(f"row separator {pattern!r} matches the empty text")
    if not _break_is_last(parsed):
        raise ValueError(f"row separator {pattern!r}: a line break can only be the last character of a separator")
    return re.match(pattern, "\n") is not None


def records(lines: Wrangler, pattern: str) -> Wrangler:
    """Rows separated by every match of a regex, from a frame of lines, so that files are
    read in splits from any store that Spark reads.

    A line with its line break is cut at the matches inside. Where a line break alone is a
    separator, every line ends a row, and nothing is moved. Elsewhere the pieces between two
    separators, which may lie in different splits, are gathered by a running count. A separator
    may hold a line break as its last character only (``\\r?\\n|;``, ``[;|]``, ``;\\n?``); others raise.
    A file that does not end with a line break is read as if it did; that line break is no part
    of its last row, and an empty row at its end is dropped."""
    closed = _check_separator(pattern)
    value, sub = F.col("value"), f"{HIDDEN}sub"
    keys = [FILE, BLOCK, POS]
    cut = lines.df.select(*keys, F.split(F.concat(value, F.lit("\n")), pattern, -1).alias("pieces"))
    if closed:  # the last piece, behind the line's end, is empty
        cut = cut.select(*keys, F.slice("pieces", F.lit(1), F.size("pieces") - 1).alias("pieces"))
    else:
        ends = lines.df.groupBy(FILE).agg(F.max(F.struct(BLOCK, POS)).alias("last"))  # a row per file
        final = F.regexp_replace(F.element_at("pieces", -1), "\n$", "")
        whole = F.concat(F.slice("pieces", F.lit(1), F.size("pieces") - 1), F.array(final))
        cut = cut.join(ends, FILE).select(*keys, F.when(F.struct(BLOCK, POS) == F.col("last"), whole).otherwise(F.col("pieces")).alias("pieces"))
    long = cut.select(*keys, F.posexplode("pieces").alias(sub, "value"))
    w = Wrangler._raw(long, order=(*keys, sub), prefix=(FILE, BLOCK), prefix_unbounded=True)
    if closed:
        return w._with(df=long.select("value", *keys, sub))
    rid, row = w.fresh("__rid"), w.fresh("__row")
    df, w2 = ordered_scan(w, rid=rid, csum={row: (F.col(sub) > 0).cast("long")})
    out = gathered(df, [FILE, row], rid, {"value": value})
    text = F.array_join(F.col(ROWS)["value"], "")
    # only a file's last row can be empty and end at no separator
    nxt = df.groupBy(FILE).agg(F.max(row).alias("__end"))
    out = out.select(FILE, row, text.alias("value")).join(nxt, FILE)
    out = out.where((F.col("value") != "") | (F.col(row) < F.col("__end"))).select("value", FILE, row)
    return Wrangler._raw(out, order=(FILE, row), qkey=FILE, depth=w2.depth)


def split_lines(w: Wrangler, column: str = "value", cols: str | None = ",",
                width: int | None = None, max_columns: int = 10_000) -> Wrangler:
    """Split a line column on every match of regex ``cols`` into ``c0..cN``
    (JVM split semantics, ragged rows padded with ''). Width: the widest row
    (one small aggregate), or given – then no aggregate runs and a longer row
    fails the job."""
    if cols is None:
        return w
    tmp = w._with(df=w.df.withColumnRenamed(column, "c"), same_rows=True)
    if width is None:
        out = spread(tmp, {"c": jvm_split(F.col("c"), cols)}, max_columns=max_columns)
    else:
        pieces, too_long = split_within(F.col("c"), cols, width)
        out = spread(tmp, {"c": pieces}, width=width, max_columns=max_columns, too_long=too_long)
    n = len(out.columns) - (len(w.cells) - 1)
    ren = {f"c_{i + 1}": f"c{i}" for i in range(n)}
    return out._with(df=out.df.withColumnsRenamed(ren), same_rows=True)


def read_text(spark: SparkSession, path, rows: str | Regex = "\n", cols: str | None = None,
              width: int | None = None, names: list[str] | None = None,
              max_columns: int = 10_000) -> Wrangler:
    """Load delimited text as an all-string table. ``cols`` is a regex
    (JVM ``split``); no quoting rules, unlike ``read.csv``."""
    w = read_lines(spark, path, rows)
    if cols is not None:
        w = split_lines(w, "value", cols, width, max_columns)
    if names is not None:
        w = w.promote(names=names)
    return w


def lines_from(df: DataFrame, line, order_by=None, cols: str | None = ",",
               width: int | None = None) -> Wrangler:
    """S1 on a text column Spark already holds (e.g. derived from a table):
    split it like a loaded file; ``order_by`` gives the row order if any."""
    value = quoted(line) if isinstance(line, str) else line
    keys = [] if order_by is None else (order_by if isinstance(order_by, list) else [order_by])
    keys = [quoted(k) if isinstance(k, str) else k for k in keys]
    named = [f"__key{i}" for i in range(len(keys))]
    w = Wrangler(df.select(value.alias("value"), *[k.alias(n) for k, n in zip(keys, named)]), order_by=named or None)
    w = w._with(df=w.df.select("value", *w.order))
    return split_lines(w, "value", cols, width)


def output_name(path: str, ext: str = "rdd") -> str:
    """``x.csv`` -> ``x.rdd``, ``x.rdd`` -> ``x.rdd.rdd``, no extension -> add."""
    p = PurePosixPath(path)
    if p.suffix == f".{ext}" or not p.suffix:
        return f"{path}.{ext}"
    return str(p.with_suffix(f".{ext}"))
