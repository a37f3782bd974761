"""Row order without single-task windows: the *bucket + carry* plan.

``Window.orderBy(k)`` with no partition pulls every row into one task. Verbs
that depend on row order (row ids, fill up/down, running match counts) instead

1. cut the order into K contiguous buckets whose bounds are *literals*: quantiles of a
   sample of rows, compared as they sort, so the bucket expression is deterministic
   across re-computation and even for any type and skew. A key that covers several
   quantiles is cut within by the hash of its rows' cells, which orders ties anyway;
2. move the data once, by (part, bucket), and sort it; in-bucket windows give running
   values, and the last (first) row of each bucket holds what the bucket adds;
3. these rows, at most K per partition key, come from the *same* exchange (Spark reuses
   it, since both branches ask for the same columns in the same distribution); windows over
   them give each bucket's offset and carry-in, which are joined back by plain equality
   (Spark broadcasts them if they are small).

So a verb reads its input once, after one narrow job that counts it and samples keys (none
if the bounds are known from an earlier verb). Columns dropped *after* an ordered verb make
the branches differ, which costs a second exchange; drop them before. Each bucket holds ~N/K
rows whatever the skew of the keys or of ``_part``; K grows with
``spark.sql.shuffle.partitions`` (or ``sheaf.order.buckets``). Only rows that are equal in
every column stay together.

Verbs that address rows by number do not order the table at all: ``addresses`` finds the
keys of these rows, and the plan compares every row with them where it is read.
"""

from __future__ import annotations

import warnings
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:  # pragma: no cover
    from ..frame import Wrangler

#: Sampled keys per bucket: with 16 a bucket of over 3N/K rows is a one-in-a-million event.
SAMPLE_PER_BUCKET = 16
#: Most sampled keys that the driver takes.
MAX_SAMPLE = 1 << 18
#: Rows with numbers below this are found from the top.
NEAR_TOP = 10_000
#: Rows per bucket that more buckets than 2 x shuffle partitions are made for.
BUCKET_ROWS = 4_000_000
_FAN = 16
#: So many bounds are compared one by one, more by a search tree.
FLAT = 64


def bucket_count(spark, rows: int) -> int:
    """K: ``sheaf.order.buckets`` if set, else 2 x shuffle partitions, or more where buckets
    would pass ``BUCKET_ROWS`` rows."""
    conf = spark.conf.get("sheaf.order.buckets", None)
    if conf:
        return max(1, int(conf))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(4, 2 * parts, -(-rows // BUCKET_ROWS))


def sort_keys(w: "Wrangler") -> list[Column]:
    """The row order; rows with equal keys are ordered by a hash of their cells, so that
    every run puts them alike (equal rows are interchangeable)."""
    keys = [F.col(c).asc_nulls_first() for c in w.order]
    return keys if w.prefix_unbounded else [*keys, tie_break(w.df)]


def tie_break(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c, t in df.dtypes if _hashable(t)])


def _hashable(kind: str) -> bool:
    return "map<" not in kind and "variant" not in kind


def _ascending(keys: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in keys]


def _sampled(df: DataFrame, keys: list[str]) -> tuple[int, int, list[tuple]]:
    """(rows, K, a sorted sample of the rows' keys), from one job: the rows are counted while
    the smallest random numbers are picked. Only a table that needs more buckets than the
    session's default is sampled again."""
    spark = df.sparkSession
    k = bucket_count(spark, 0)
    seen, draw = Observation(), "__draw"
    picked = (df.select(*keys).observe(seen, F.count(F.lit(1)).alias("n")).withColumn(draw, F.rand(7))
              .orderBy(draw).limit(SAMPLE_PER_BUCKET * k).select(*keys).orderBy(*_ascending(keys)))
    rows = [tuple(r) for r in picked.collect()]
    n = seen.get["n"]
    if bucket_count(spark, n) > k:
        k = bucket_count(spark, n)
        part = min(1.0, min(SAMPLE_PER_BUCKET * k, MAX_SAMPLE) / n)
        rows = [tuple(r) for r in df.select(*keys).sample(part, seed=7).orderBy(*_ascending(keys)).collect()]
    return n, k, rows


def compute_bounds(df: DataFrame, keys: list[str]) -> tuple:
    """At most K-1 bounds, evenly spread over a sample of rows. Rows are compared with them as
    they sort, column by column: any bounds give right results, and these give even buckets
    whatever the type and skew of the keys. Where a key is drawn more than once, bounds get one
    more part, for the hash that orders ties: it is spread evenly over its 64 bits."""
    n, k, rows = _sampled(df, keys)
    if k <= 1 or not rows:
        return ()
    at = [len(rows) * i // k for i in range(1, k)]
    picked = list(dict.fromkeys(rows[i] for i in at))
    if len(picked) == len(at):
        return tuple(picked)
    first, last = {}, {}
    for i, r in enumerate(rows):
        first.setdefault(r, i)
        last[r] = i
    low = -(1 << 63)
    cut = [(*rows[i], low + ((i - first[rows[i]]) << 64) // (last[rows[i]] - first[rows[i]] + 1)) for i in at]
    return tuple(dict.fromkeys(cut))


def bucket_of(df: DataFrame, keys: list[str], bounds: tuple, tie: Column | None = None) -> Column:
    """Number of bounds at or below the row's key, by a search tree of literals."""
    types = dict(df.dtypes)
    if not bounds:
        return F.lit(0)
    cols = [(F.col(c), types[c]) for c in keys]
    if len(bounds[0]) > len(keys):
        cols.append((tie_break(df) if tie is None else tie, "bigint"))
    cols = cols[: len(bounds[0])]
    key = F.struct(*[c.alias(f"k{i}") for i, (c, _) in enumerate(cols)])

    def literal(bound: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, ((_, t), v) in enumerate(zip(cols, bound))])

    if len(bounds) <= FLAT:  # comparisons that are compiled; more would make the code too long
        if len(cols) == 1:  # nulls sort first: they are at or above null bounds only
            (c, t), nulls = cols[0], sum(b[0] is None for b in bounds)
            above = [F.coalesce((c >= F.lit(b[0]).cast(t)).cast("int"), F.lit(0)) for b in bounds if b[0] is not None]
        else:
            above, nulls = [(key >= literal(b)).cast("int") for b in bounds], 0
        return F.coalesce(reduce(lambda x, y: x + y, above, F.lit(nulls)), F.lit(0))
    lits = [literal(b) for b in bounds]
    none = F.slice(F.array(lits[0]), F.lit(1), F.lit(0))
    size = _FAN
    while size < len(bounds) + 1:
        size *= _FAN
    at = F.lit(0)
    while size > 1:  # block i of this level covers the buckets i*size .. (i+1)*size - 1
        child = size // _FAN
        blocks = []
        for start in range(0, len(bounds) + 1, size):
            own = [lits[x] for x in range(start + child - 1, min(start + size - 1, len(lits)), child)]
            blocks.append(F.array(*own) if own else none)
        steps = F.get(F.array(*blocks), at)
        at = at * _FAN + F.size(F.filter(steps, lambda b: b <= key))
        size = child
    return F.coalesce(at, F.lit(0))


def bucketed(w: "Wrangler", tie: str | None = None) -> tuple[DataFrame, list[str], "Wrangler"]:
    """(frame with a bucket column, columns that name a row's bucket, wrangler with bounds)."""
    if not w.order:
        raise ValueError("this verb needs a row order: pass order_by= or read a text source")
    df, cols = w.df, list(w.prefix)
    if w.qkey is not None:
        keys = list(w.order[w.order.index(w.qkey):])
        bounds = w.bounds
        if bounds is None:
            bounds = compute_bounds(w.keys, keys)
            w = w._with(bounds=bounds)
        name = w.fresh("__bkt")
        df = df.withColumn(name, bucket_of(df, keys, bounds, None if tie is None else F.col(tie)))
        cols.append(name)
    return df, cols, w


# -- rows by number ------------------------------------------------------------

def _literal_key(types: dict, keys: list[str], row: tuple) -> Column:
    return F.struct(*[F.lit(v).cast(types[c]).alias(f"k{i}") for i, (c, v) in enumerate(zip(keys, row))])


def is_one_of(df: DataFrame, keys: list[str], rows: list[tuple]) -> Column:
    """The row's key is one of ``rows``; nulls equal nulls."""
    types = dict(df.dtypes)
    if len(keys) == 1 and all(r[0] is not None for r in rows):
        return F.coalesce(F.col(keys[0]).isin(*[F.lit(r[0]).cast(types[keys[0]]) for r in rows]), F.lit(False))
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])
    return key.isin(*[_literal_key(types, keys, r) for r in rows])


def _alone(around: list[tuple], i: int) -> bool:
    """No neighbour of row ``i`` has its key."""
    return all(around[j] != around[i] for j in (i - 1, i + 1) if 0 <= j < len(around))


def _near_top(df: DataFrame, keys: list[str], top: int) -> list[tuple]:
    """The keys of the first ``top + 2`` rows: each task keeps as many, none are moved."""
    return [tuple(r) for r in df.select(*keys).orderBy(*_ascending(keys)).limit(top + 2).collect()]


def _far_down(w: "Wrangler", df: DataFrame, keys: list[str], rows: list[int], tie: str | None) -> tuple[int, dict[int, tuple], bool, "Wrangler"]:
    """(rows in the table, key of each addressed row, all alone?, wrangler with bounds). The
    buckets are counted, and only those that hold an addressed row are sorted."""
    bdf, bcols, w = bucketed(w._with(df=df), tie)
    if tie is None and w.bounds and len(w.bounds[0]) > len(keys) - w.order.index(w.qkey):
        return 0, {}, False, w  # a key lies in several buckets
    counts = bdf.groupBy(*bcols).count().orderBy(*_ascending(bcols)).collect()  # one row a bucket
    total, hold = 0, {}
    for c in counts:
        here = [r for r in rows if total <= r < total + c["count"]]
        if here:
            hold[tuple(c[b] for b in bcols)] = (total, here)
        total += c["count"]
    if not hold:
        return total, {}, True, w
    few = bdf.where(is_one_of(bdf, bcols, list(hold)))
    win = Window.partitionBy(*bcols).orderBy(*_ascending(keys))
    key = F.struct(*[F.col(c) for c in keys])
    few = few.select(*bcols, *keys, F.row_number().over(win).alias("__n"),
                     (F.coalesce(F.lag(key).over(win) == key, F.lit(False))
                      | F.coalesce(F.lead(key).over(win) == key, F.lit(False))).alias("__twin"))
    wanted = [(*b, r - start + 1) for b, (start, here) in hold.items() for r in here]
    found = {tuple(r[b] for b in [*bcols, "__n"]): r for r in few.where(is_one_of(few, [*bcols, "__n"], wanted)).collect()}
    out = {}
    for b, (start, here) in hold.items():
        for r in here:
            out[r] = tuple(found[(*b, r - start + 1)][c] for c in keys)
    return total, out, not any(r["__twin"] for r in found.values()), w


def addresses(w: "Wrangler", rows: list[int]) -> tuple["Wrangler", Column | None, dict[int, tuple], list[str]]:
    """(wrangler, condition that holds for exactly the rows with these numbers, key of each,
    key columns); the condition is None where keys do not tell the rows apart (rows equal in
    every column), or depend on how files are cut (text). A number beyond the table raises.

    Few rows from the top are found by a top-k of keys, others in their buckets; ties of the
    order key are looked at only where an addressed row has one."""
    if w.prefix_unbounded:
        return w, None, {}, []
    top = max(rows)
    keys = list(w.order)
    tied = w.fresh("__tie")
    for with_tie in (False, True):
        df = w.df.withColumn(tied, tie_break(w.df)) if with_tie else w.df
        names = [*keys, tied] if with_tie else keys
        if top < NEAR_TOP:
            around = _near_top(df if with_tie else w.keys, names, top)
            total = len(around)
            got = {r: around[r] for r in rows if r < total}
            alone = all(_alone(around, r) for r in got)
        else:
            total, got, alone, seen = _far_down(w, df, names, sorted(set(rows)), tied if with_tie else None)
            w = w._with(bounds=seen.bounds)
            if not alone and not got:
                continue
        if len(got) < len(set(rows)):
            raise ValueError(f"row {top} is out of range: the table has {total} rows")
        if alone:
            out = w._with(df=df) if with_tie else w
            return out, is_one_of(df, names, list(dict.fromkeys(got.values()))), got, names
    return w, None, {}, []


def never_null(df: DataFrame, cols: list[str], taken: "Wrangler") -> tuple[DataFrame, list[str], list[str]]:
    """Grouping columns for ``cols`` without nulls, so that groups join by plain equality and
    keep the partitioning of the window: a null becomes an empty value, and for the partition
    key, where that is a key too, a flag tells them apart."""
    types, out, made = dict(df.dtypes), [], []
    for c in cols:
        name = taken.fresh(f"__g{len(made)}", extra=made)
        kind = types[c]
        empty = F.lit("" if kind == "string" else 0).cast(kind)
        df = df.withColumn(name, F.coalesce(F.col(c), empty))
        made.append(name)
        out.append(name)
        if c in taken.part_cols:
            flag = taken.fresh(f"__g{len(made)}", extra=made)
            df = df.withColumn(flag, F.col(c).isNull())
            made.append(flag)
            out.append(flag)
    return df, out, made


def ordered_scan(
    w: "Wrangler",
    rid: str | None = None,
    ffill: dict[str, Column] | None = None,
    bfill: dict[str, Column] | None = None,
    csum: dict[str, Column] | None = None,
    count: str | None = None,
    last_hit: dict[str, Column] | None = None,
    shift: tuple[dict[str, str], int] | None = None,
) -> tuple[DataFrame, "Wrangler"]:
    """Add running columns computed in row order (per ``_part`` if present).

    * ``rid``      – 0-based dense row index,
    * ``ffill``    – ``{out: expr}`` last non-null ``expr`` at or before the row,
    * ``bfill``    – ``{out: expr}`` first non-null ``expr`` at or after the row,
    * ``csum``     – ``{out: expr}`` running sum of ``expr`` up to and incl. the row,
    * ``count``    – total rows of the row's partition (or table),
    * ``last_hit`` – ``{out: cond}`` row index of the last row at or before
      this one where ``cond`` holds (null before the first),
    * ``shift``    – ``({out: column}, d)`` the column's cell in the row ``d`` before this one (behind it, if
      negative; null beyond the table): inside a bucket by ``lag``, across buckets from the |d|
      rows at their ends, which are broadcast (``shift_fits`` bounds their number).

    Plan: one exchange by (part, bucket), a sort, in-bucket windows; the side table is the
    last (for ``bfill`` the first) row of each bucket, from the same exchange.
    """
    ffill, bfill, csum, last_hit = ffill or {}, bfill or {}, csum or {}, last_hit or {}
    w.require_batch("an ordered verb")
    if w.dense and not w.has_part and not (ffill or bfill or csum or last_hit or shift):
        return _numbered(w, rid, count)
    w = _cut_lineage(w)
    tie = [] if w.prefix_unbounded else [w.fresh("__tie")]  # keys of a text source are unique
    if tie:
        w = w._with(df=w.df.withColumn(tie[0], tie_break(w.df)))
    df, bcols, w = bucketed(w, *tie)
    df, part, made = never_null(df, w.part_cols, w)
    df = df.drop(*w.part_cols)  # put together again below, so that it is moved once
    n_part = len(part)
    df, keys, more = never_null(df, [c for c in w.prefix], w._with(df=df))
    keys = [*part, *keys, *[c for c in bcols if c not in w.prefix]]
    bcols, made = keys[n_part:], [*made, *more, *[c for c in bcols if c not in w.prefix], *tie]
    order = _ascending([*w.order, *tie])

    tmp: dict[str, str] = {}

    def t(name):
        tmp[name] = w.fresh("__s_" + name, extra=list(tmp.values()))
        return tmp[name]

    specs = ([("f", o, e) for o, e in ffill.items()] + [("b", o, e) for o, e in bfill.items()]
             + [("c", o, e) for o, e in csum.items()] + [("h", o, e) for o, e in last_hit.items()])
    src = {}
    for kind, out, expr in specs:
        src[(kind, out)] = t(f"in_{kind}_{out}")
        df = df.withColumn(src[(kind, out)], expr)
    moves, step = shift or ({}, 0)
    moved = df.columns

    # -- in-bucket running values ----------------------------------------------
    win = Window.partitionBy(*keys).orderBy(*order)
    upto = win.rowsBetween(Window.unboundedPreceding, 0)
    # "first non-null at or after" as a running last() over the reversed order:
    # (current, unbounded following) frames are re-aggregated per row (quadratic)
    rev = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in [*w.order, *tie]])
    after_row = rev.rowsBetween(Window.unboundedPreceding, 0)
    rn = t("rn")
    local = {rn: F.row_number().over(win)}
    for kind, out, _ in specs:
        s = F.col(src[(kind, out)])
        name = t(f"loc_{kind}_{out}")
        if kind == "f":
            local[name] = F.last(s, ignorenulls=True).over(upto)
        elif kind == "b":
            local[name] = F.last(s, ignorenulls=True).over(after_row)
        elif kind == "c":
            local[name] = F.sum(s).over(upto)
    df = df.withColumn(rn, local.pop(rn))
    for kind, out, _ in specs:
        if kind == "h":
            local[tmp[f"loc_h_{out}"]] = F.last(F.when(F.col(src[("h", out)]), F.col(rn)), ignorenulls=True).over(upto)
    for out in moves:
        local[t(f"loc_s_{out}")] = F.lag(F.col(moves[out]), step).over(win)
    if local:
        df = df.withColumns(local)

    # -- side table: the rows at the buckets' ends -------------------------------
    side = _ends(df, keys, moved, F.lead(F.lit(1)).over(win), [
        (F.col(rn), t("n")), *[(F.col(tmp[f"loc_{k}_{o}"]), t(f"agg_{k}_{o}")) for k, o, _ in specs if k != "b"]])
    back = [(F.col(tmp[f"loc_b_{o}"]), t(f"agg_b_{o}")) for k, o, _ in specs if k == "b"]
    if back:
        side = _join(side, _ends(df, keys, moved, F.lead(F.lit(1)).over(rev), back), keys, "inner")
    n_col = tmp["n"]
    ws = Window.partitionBy(*part).orderBy(*_ascending(bcols))
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    following = ws.rowsBetween(1, Window.unboundedFollowing)
    off = t("off")
    side = side.withColumn(off, F.coalesce(F.sum(n_col).over(before), F.lit(0)))
    sel = [*keys, off, *([n_col] if moves else [])]
    if count:
        sel.append(F.sum(n_col).over(Window.partitionBy(*part)).alias(t("tot")))
    for kind, out, _ in specs:
        a = F.col(tmp[f"agg_{kind}_{out}"])
        name = t(f"carry_{kind}_{out}")
        if kind == "f":
            sel.append(F.last(a, ignorenulls=True).over(before).alias(name))
        elif kind == "b":
            sel.append(F.first(a, ignorenulls=True).over(following).alias(name))
        elif kind == "c":
            sel.append(F.coalesce(F.sum(a).over(before), F.lit(0)).alias(name))
        else:
            glob = F.when(a.isNotNull(), F.col(off) + a - 1)
            sel.append(F.last(glob, ignorenulls=True).over(before).alias(name))
    side = side.select(*sel)
    edge = None
    if moves:  # rows whose place d further on is in another bucket, by their number
        edge = _ends(df, keys, moved, F.lead(F.lit(1), step).over(win),
                     [(F.col(rn), rn), *[(F.col(c), t(f"edge_{o}")) for o, c in moves.items()]])
        edge = _join(edge, side.select(*keys, off), keys, "inner").select(
            (F.col(off) + F.col(rn) - 1 + step).alias(t("to")), *[tmp[f"edge_{o}"] for o in moves])
    df = _join(df, side, keys, "left")
    if moves:
        at = F.col(off) + F.col(rn) - 1
        outside = (F.col(rn) <= step) if step >= 0 else (F.col(rn) - step > F.col(n_col))
        df = df.withColumn(t("need"), F.when(outside, at))
        df = df.join(F.broadcast(edge), F.col(tmp["need"]) == F.col(tmp["to"]), "left")

    new_cols = {}
    if rid:
        new_cols[rid] = (F.col(off) + F.col(rn) - 1).cast("long")
    if count:
        new_cols[count] = F.col(tmp["tot"]).cast("long")
    for kind, out, _ in specs:
        loc = F.col(tmp[f"loc_{kind}_{out}"])
        carry = F.col(tmp[f"carry_{kind}_{out}"])
        if kind in ("f", "b"):
            new_cols[out] = F.coalesce(loc, carry)
        elif kind == "c":
            new_cols[out] = carry + F.coalesce(loc, F.lit(0))
        else:
            new_cols[out] = F.coalesce((F.col(off) + loc - 1).cast("long"), carry.cast("long"))
    for out in moves:
        new_cols[out] = F.when(F.col(tmp["need"]).isNotNull(), F.col(tmp[f"edge_{out}"])).otherwise(F.col(tmp[f"loc_s_{out}"]))
    for c, (copy, is_null) in zip(w.part_cols, [part]):
        new_cols[c] = F.when(~F.col(is_null), F.col(copy))
    df = df.withColumns(new_cols)
    drop = [c for c in tmp.values() if c in df.columns] + made
    return df.drop(*drop), w._with(depth=w.depth + 1)


def _ends(df: DataFrame, keys: list[str], moved: list[str], beyond: Column, values: list[tuple[Column, str]]) -> DataFrame:
    """``values`` of the rows that have no row ``beyond`` them in their bucket. The test that
    always holds names every column that the data's own exchange moves: then this branch asks
    for the same exchange, and Spark makes it once."""
    end, types = "__end", dict(df.dtypes)
    named = [F.col(c) if _hashable(types[c]) else F.col(c).isNull() for c in moved]
    return (df.withColumn(end, beyond).where(F.col(end).isNull() & (F.xxhash64(*named) >= F.lit(-(1 << 63))))
            .select(*keys, *[v.alias(name) for v, name in values]))


def _numbered(w: "Wrangler", rid: str | None, count: str | None) -> tuple[DataFrame, "Wrangler"]:
    """Row numbers of a text source none of whose rows are gone: a row's place in its split is
    its position less the split's first, so only counts per split are moved, no lines."""
    split = list(w.prefix)
    pos = w.order[-1]
    n, low, off = (w.fresh(f"__split_{x}") for x in ("n", "low", "off"))
    side = w.df.groupBy(*split).agg(F.count(F.lit(1)).alias(n), F.min(pos).alias(low))
    before = Window.orderBy(*_ascending(split)).rowsBetween(Window.unboundedPreceding, -1)
    cols = [*split, low, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off)]
    if count:
        cols.append(F.sum(n).over(Window.partitionBy()).cast("long").alias(count))
    df = _join(w.df, side.select(*cols), split, "left")
    if rid:
        df = df.withColumn(rid, F.col(off) + F.col(pos) - F.col(low))
    made = [c for c in (rid, count) if c]
    return df.select(*w.df.columns, *made), w._with(depth=w.depth + 1)


#: Most rows at bucket ends that a shift broadcasts.
EDGE_ROWS = 100_000


def shift_fits(w: "Wrangler", distance: int) -> tuple["Wrangler", bool]:
    """(wrangler with bounds, whether a shift by so many rows broadcasts at most ``EDGE_ROWS``)."""
    if w.has_part or w.prefix or w.qkey is None:
        return w, False  # the number of buckets is not known here
    _, _, w = bucketed(w)
    return w, distance * (len(w.bounds) + 1) <= EDGE_ROWS


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on the grouping columns, which hold no nulls."""
    return left.join(right, on=keys, how=how)


def _cut_lineage(w: "Wrangler") -> "Wrangler":
    """Where a later verb drops columns, an ordered scan may read its input twice, so a long
    chain of them could recompute the lineage 2^depth times; past
    ``sheaf.order.checkpointDepth`` (default 2) the input is checkpointed."""
    limit = int(w.spark.conf.get("sheaf.order.checkpointDepth", "2"))
    if w.depth < limit:
        return w
    cut = w.checkpoint()
    if cut is w:
        warnings.warn("no spark.checkpoint.dir: deep ordered chains are recomputed")
    return cut
