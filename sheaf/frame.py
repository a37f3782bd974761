"""The fluent, immutable table handle.

``Wrangler`` wraps one DataFrame. Data columns are the user's columns; a few
hidden columns (names starting with ``__``) carry the row order, and an
optional ``_part`` column holds the partition key set by ``partition`` (M1).
Every verb returns a new ``Wrangler`` whose DataFrame is a lazy plan; nothing
runs until a sink (or one of the documented small eager aggregates) does.
"""

from __future__ import annotations

import re
from typing import Any, Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "_part"
HIDDEN = "__"


_PLAIN = re.compile(r"[a-z][a-z0-9_]*\Z")
_CODED = "x0"


def inner(name: str) -> str:
    """The DataFrame column that holds the data column ``name``. Any text can be a header
    (dots, quotes, names that differ by case only, names of hidden columns): names that are
    not plain lower-case identifiers are spelled in hex, so the plans only see safe ones."""
    if _PLAIN.match(name) and not name.startswith(_CODED):
        return name
    return _CODED + name.encode("utf-8", "surrogatepass").hex()


def outer(column: str) -> str:
    """The header of a data column: the inverse of ``inner``."""
    if column.startswith(_CODED):
        return bytes.fromhex(column[len(_CODED):]).decode("utf-8", "surrogatepass")
    return column


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _listify(x) -> list:
    if x is None:
        return []
    if isinstance(x, (list, tuple)):
        return list(x)
    return [x]


class Wrangler:
    """Table of (mostly string) cells with an optional row order and partition key.

    ``order_by``: column name(s) or Column(s) giving a unique row order; they
    are copied into hidden columns, so later edits of data cells never change
    the order. ``part``: column name or Column used as the partition key.
    """

    def __init__(self, df: DataFrame, order_by=None, part=None):
        names = df.columns
        if len(set(names)) != len(names):
            raise ValueError(f"column names are not unique: {names}")

        def key_column(k) -> Column:
            return quoted(k) if isinstance(k, str) else k

        keys = [key_column(k) for k in _listify(order_by)]
        order = tuple(f"{HIDDEN}ord{i}" for i in range(len(keys)))
        more = [key_column(part)] if part is not None else []
        # by position: user names may clash with each other (case) or with hidden ones
        df = df.select("*", *keys, *more).toDF(
            *[inner(c) for c in names], *order, *([PART] if more else []))
        self._init(df, order, (), order[0] if order else None, None, False)

    # -- construction -------------------------------------------------------
    def _init(self, df, order, prefix, qkey, bounds, prefix_unbounded, depth=0, dense=False):
        self._dtypes = None
        self.created: tuple = ()  # columns made by the verb that returned this frame
        self.depth = depth  # ordered scans in the lineage since the last checkpoint
        self.df = df
        self.order = tuple(order)
        self.prefix = tuple(prefix)
        self.qkey = qkey
        self.bounds = bounds
        self.prefix_unbounded = prefix_unbounded
        self.dense = dense  # a text source none of whose rows are gone: positions have no gaps
        self.lean = None  # a frame with the same rows and order columns that is cheaper to read

    @classmethod
    def _raw(cls, df, order=(), prefix=(), qkey=None, bounds=None, prefix_unbounded=False,
             depth=0, dense=False):
        w = cls.__new__(cls)
        w._init(df, order, prefix, qkey, bounds, prefix_unbounded, depth, dense)
        return w

    _KEEP = object()

    def _with(self, df=_KEEP, order=_KEEP, prefix=_KEEP, qkey=_KEEP, bounds=_KEEP,
              prefix_unbounded=_KEEP, depth=_KEEP, same_rows=False) -> "Wrangler":
        """A copy with some parts replaced. A new frame may hold other rows: verbs that keep
        every row say so with ``same_rows``."""
        k = Wrangler._KEEP
        same_rows = same_rows or df is k
        out = Wrangler._raw(
            self.df if df is k else df,
            self.order if order is k else order,
            self.prefix if prefix is k else prefix,
            self.qkey if qkey is k else qkey,
            self.bounds if bounds is k else bounds,
            self.prefix_unbounded if prefix_unbounded is k else prefix_unbounded,
            self.depth if depth is k else depth,
            self.dense and same_rows,
        )
        if same_rows and out.order == self.order:
            out.lean = self.lean
        return out

    @property
    def keys(self) -> DataFrame:
        """The frame to read order keys from."""
        return self.df if self.lean is None else self.lean

    def checkpoint(self) -> "Wrangler":
        """Cut the lineage: a reliable checkpoint into the session's
        ``spark.checkpoint.dir`` (survives executor loss). Without a configured
        folder the plan is kept as is (results are the same, only recomputed)."""
        from .session import checkpoint_dir

        if self.is_streaming or checkpoint_dir(self.spark) is None:
            return self
        return self._with(df=self.df.checkpoint(eager=True), depth=0, same_rows=True)

    # -- introspection ------------------------------------------------------
    @property
    def cells(self) -> list[str]:
        """DataFrame columns that hold data."""
        return [c for c in self.df.columns if not c.startswith(HIDDEN) and c != PART]

    @property
    def columns(self) -> list[str]:
        """The header."""
        return [outer(c) for c in self.cells]

    @property
    def has_part(self) -> bool:
        return PART in self.df.columns

    @property
    def part_cols(self) -> list[str]:
        return [PART] if self.has_part else []

    @property
    def is_streaming(self) -> bool:
        return self.df.isStreaming

    @property
    def spark(self):
        return self.df.sparkSession

    def fresh(self, base: str, extra: Iterable[str] = ()) -> str:
        taken = set(self.df.columns) | set(extra)
        name, i = base, 0
        while name in taken:
            i += 1
            name = f"{base}{i}"
        return name

    def dtype(self, name: str) -> str:
        if self._dtypes is None:
            self._dtypes = dict(self.df.dtypes)
        return self._dtypes[name]

    def text(self, name: str) -> Column:
        """Column as string (verbs work on text; other types are cast)."""
        c = F.col(name)
        return c if self.dtype(name) == "string" else c.cast("string")

    def resolve(self, spec) -> list[str]:
        """H4: int | name | list of those | None (= all) -> DataFrame columns."""
        cols = self.cells
        if spec is None:
            return list(cols)
        out: list[str] = []
        for s in _listify(spec):
            if isinstance(s, bool):
                raise ValueError(f"bad column {s!r}")
            if isinstance(s, int):
                if s < 0 or s >= len(cols):
                    raise ValueError(f"column index {s} out of range 0..{len(cols) - 1}")
                name = cols[s]
            elif isinstance(s, str):
                name = inner(s) if inner(s) in cols else s
                if name not in cols:
                    raise ValueError(f"unknown column {s!r}; columns are {self.columns}")
            else:
                raise ValueError(f"bad column {s!r}")
            if name not in out:
                out.append(name)
        return out

    def require_batch(self, verb: str) -> None:
        if self.is_streaming:
            raise ValueError(
                f"{verb} depends on row order or needs an aggregate; it cannot run on a "
                "streaming DataFrame (only row-local verbs can)"
            )

    def to_df(self, with_part: bool = True) -> DataFrame:
        return self.df.select(*self._shown(with_part))

    def _shown(self, with_part: bool) -> list[Column]:
        return [F.col(c).alias(outer(c)) for c in self.cells] + [
            F.col(c) for c in (self.part_cols if with_part else [])]

    def ordered_df(self, with_part: bool = True) -> DataFrame:
        """Data columns sorted in row order (a global sort: for sinks/previews)."""
        d = self.df
        if self.order:
            d = d.orderBy(*self.part_cols, *[F.col(c).asc_nulls_first() for c in self.order])
        return d.select(*self._shown(with_part))

    def select_cells(self, exprs: dict[str, Column]) -> "Wrangler":
        """Replace the given data columns in place, keep everything else."""
        out = [exprs[c].alias(c) if c in exprs else F.col(c) for c in self.df.columns]
        return self._with(df=self.df.select(*out), same_rows=True)

    def __repr__(self):
        return (f"Wrangler(columns={self.columns}, order={list(self.order)}, "
                f"part={self.has_part})")

    # -- row order ----------------------------------------------------------
    def with_row_id(self, name: str = "row_id") -> "Wrangler":
        """Expose the 0-based row index (per ``_part``) as a data column."""
        from .plans.order import ordered_scan

        self.require_batch("row_id")
        df, w = ordered_scan(self, rid=inner(name))
        return w._with(df=df)

    def _rid(self) -> tuple[DataFrame, str, "Wrangler"]:
        from .plans.order import ordered_scan

        self.require_batch("a row-addressed verb")
        name = self.fresh("__rid")
        df, w = ordered_scan(self, rid=name)
        return df, name, w

    # -- header (H1-H5) -----------------------------------------------------
    def promote(self, names: list[str] | None = None, row: int | None = None) -> "Wrangler":
        from .operators import rows
        return rows.promote(self, names, row)

    def demote(self, row: int = 0) -> "Wrangler":
        from .operators import rows
        return rows.demote(self, row)

    def rename(self, mapping) -> "Wrangler":
        """Rename columns: ``{old: new}``, or a sequence of new names for the
        columns the previous verb created (``w["T"].split(" ").rename(("D", "T"))``)."""
        if not isinstance(mapping, dict):
            names = list(mapping)
            if len(names) != len(self.created):
                raise ValueError(f"{len(names)} names for the {len(self.created)} columns "
                                 f"{list(self.created)} the previous verb made")
            mapping = dict(zip(self.created, names))
        new = {self.resolve(k)[0]: inner(v) for k, v in mapping.items()}
        final = [new.get(c, c) for c in self.cells]
        if len(set(final)) != len(final):
            raise ValueError(f"names would not be unique: {[outer(c) for c in final]}")
        return self.renamed(new)

    def renamed(self, new: dict[str, str]) -> "Wrangler":
        """Data columns renamed all at once (so that names may be swapped)."""
        return self._with(df=self.df.toDF(*[new.get(c, c) for c in self.df.columns]), same_rows=True)

    def __getitem__(self, column) -> "ColumnHandle":
        """H5: ``w["X"].split(" ")`` forwards ``columns="X"``."""
        (name,) = self.resolve(column)
        return ColumnHandle(self, name)

    # -- cut (C1-C19) -------------------------------------------------------
    def cut(self, on=None, after=None, before=None, between=None, columns=None,
            max: str = "first", row=None) -> "Wrangler":
        from .operators import cut
        return cut.cut(self, on=on, after=after, before=before, between=between,
                       columns=columns, max=max, row=row)

    def cut_index(self, index: int, columns=None) -> "Wrangler":
        from .operators import cut
        return cut.cut_index(self, index, columns)

    def cut_regex(self, pattern: str, columns=None) -> "Wrangler":
        from .operators import cut
        return cut.cut_regex(self, pattern, columns)

    def cut_fn(self, fn: Callable[[Column], Column], columns=None) -> "Wrangler":
        from .operators import cut
        return cut.cut_fn(self, fn, columns)

    def cut_all(self, value: str, columns=None) -> "Wrangler":
        from .operators import cut
        return cut.cut_all(self, value, columns)

    def cut_right(self, value: str, columns=None) -> "Wrangler":
        from .operators import cut
        return cut.cut_right(self, value, columns)

    def cut_before(self, index: int, columns=None, inclusive: bool = False) -> "Wrangler":
        from .operators import cut
        return cut.cut_before(self, index, columns, inclusive)

    def edit(self, fn: Callable[[Column], Column] | None = None, value: str | None = None,
             columns=None, rows=None) -> "Wrangler":
        from .operators import cut
        return cut.edit(self, fn=fn, value=value, columns=columns, rows=rows)

    # -- split / extract (P1-P12, E1-E7) --------------------------------------
    def split(self, on=None, after=None, before=None, between=None, columns=None,
              max: str = "first", max_columns: int = 1000) -> "Wrangler":
        from .operators import split
        return split.split(self, on=on, after=after, before=before, between=between,
                           columns=columns, max=max, max_columns=max_columns)

    def split_index(self, index: int, columns=None) -> "Wrangler":
        from .operators import split
        return split.split_index(self, index, columns)

    def split_value(self, value: str, columns=None) -> "Wrangler":
        from .operators import split
        return split.split_value(self, value, columns)

    def split_fn(self, fn: Callable[[Column], Column], columns=None) -> "Wrangler":
        from .operators import split
        return split.split_fn(self, fn, columns)

    def split_right(self, value: str, columns=None) -> "Wrangler":
        from .operators import split
        return split.split_right(self, value, columns)

    def split_all(self, pattern: str, columns=None, width: int | None = None,
                  max_columns: int = 1000) -> "Wrangler":
        from .operators import split
        return split.split_all(self, pattern, columns, width, max_columns)

    def extract(self, on=None, between=None, after=None, before=None, columns=None,
                max: str = "first", max_columns: int = 1000) -> "Wrangler":
        from .operators import split
        return split.extract(self, on=on, between=between, after=after, before=before,
                             columns=columns, max=max, max_columns=max_columns)

    def extract_index(self, index: int, columns=None) -> "Wrangler":
        from .operators import split
        return split.extract_index(self, index, columns)

    def extract_value(self, value: str, columns=None) -> "Wrangler":
        from .operators import split
        return split.extract_value(self, value, columns)

    def extract_fn(self, fn: Callable[[Column], Column], columns=None) -> "Wrangler":
        from .operators import split
        return split.extract_fn(self, fn, columns)

    # -- rows and columns (F1-F9) ---------------------------------------------
    def delete(self, pred: Callable[[Column], Column] | None = None, columns=None,
               where=None, rows=None) -> "Wrangler":
        from .operators import rows as r
        return r.delete(self, pred=pred, columns=columns, where=where, rows=rows)

    def drop(self, columns) -> "Wrangler":
        names = self.resolve(columns)
        return self._with(df=self.df.drop(*names), same_rows=True)

    remove_columns = drop

    def merge(self, columns, glue: str = ",", name: str | None = None,
              placement: str = "first") -> "Wrangler":
        from .operators import rows
        return rows.merge(self, columns, glue, name, placement)

    def merge_all(self, glue: str = ",", name: str | None = None) -> "Wrangler":
        from .operators import rows
        return rows.merge(self, None, glue, name, "first")

    # -- fill (G1-G8) ---------------------------------------------------------
    def fill(self, direction: str = "down", columns=None, rows=None, blank=None) -> "Wrangler":
        from .operators import fill
        return fill.fill(self, direction, columns, rows, blank)

    def fill_down(self, columns=None, blank=None) -> "Wrangler":
        from .operators import fill
        return fill.fill_down(self, columns, blank)

    def fill_up(self, columns=None, blank=None) -> "Wrangler":
        from .operators import fill
        return fill.fill_up(self, columns, blank)

    def fill_left(self, columns=None, rows=None, blank=None) -> "Wrangler":
        from .operators import fill
        return fill.fill_side(self, "left", columns, rows, blank)

    def fill_right(self, columns=None, rows=None, blank=None) -> "Wrangler":
        from .operators import fill
        return fill.fill_side(self, "right", columns, rows, blank)

    def fill_column(self, source, target, blank=None) -> "Wrangler":
        from .operators import fill
        return fill.fill_column(self, source, target, blank)

    def fill_row(self, source: int, target, columns=None, blank=None) -> "Wrangler":
        from .operators import fill
        return fill.fill_row(self, source, target, columns, blank)

    # -- reshape (W1-W11) ---------------------------------------------------
    def wrap(self, n: int | None = None, where=None, columns=None,
             max_columns: int = 1000, width: int | None = None,
             as_array: bool = False, by: str = "column") -> "Wrangler":
        from .operators import reshape
        return reshape.wrap(self, n, where, columns, max_columns, width, as_array, by)

    def wrap_rows(self, n: int, max_columns: int = 1000) -> "Wrangler":
        from .operators import reshape
        return reshape.wrap_rows(self, n, max_columns)

    def wrap_cells(self, n: int) -> "Wrangler":
        from .operators import reshape
        return reshape.wrap_cells(self, n)

    def wrap_column(self, where, columns=None, max_columns: int = 1000,
                    width: int | None = None, by: str = "column") -> "Wrangler":
        """Wrap only the listed columns – by a pattern (W3) or every ``n``
        rows when ``where`` is an int (W1); other columns are not kept."""
        from .operators import reshape
        if isinstance(where, int) and not isinstance(where, bool):
            keep = self.resolve(columns)
            dropped = [c for c in self.cells if c not in keep]
            return reshape.wrap_rows(self.drop(dropped) if dropped else self, where, max_columns)
        return reshape.wrap_where(self, where, columns, max_columns, width, by=by)

    def fold(self, columns=None, rows=None, key: str = "key", value: str = "value",
             where: Callable[[Column], Column] | None = None,
             max_key_rows: int = 1000) -> "Wrangler":
        from .operators import reshape
        return reshape.fold(self, columns, rows, key, value, where, max_key_rows)

    def unfold(self, column, measure, values: list | None = None,
               max_values: int = 1000) -> "Wrangler":
        from .operators import reshape
        return reshape.unfold(self, column, measure, values, max_values)

    def transpose(self, max_rows: int = 1000) -> "Wrangler":
        from .operators import reshape
        return reshape.transpose(self, max_rows)

    def transpose_tiles(self, block_rows: int = 1000) -> "Wrangler":
        from .operators import reshape
        return reshape.transpose_tiles(self, block_rows)

    def translate_left(self, distance: int = 1) -> "Wrangler":
        from .operators import reshape
        return reshape.translate_cols(self, distance, left=True)

    def translate_right(self, distance: int = 1) -> "Wrangler":
        from .operators import reshape
        return reshape.translate_cols(self, distance, left=False)

    def translate_up(self, distance: int = 1) -> "Wrangler":
        from .operators import reshape
        return reshape.translate_rows(self, distance, top=False)

    def translate_down(self, distance: int = 1) -> "Wrangler":
        from .operators import reshape
        return reshape.translate_rows(self, distance, top=True)

    def translate(self, column=None, direction: str = "down", distance: int = 1) -> "Wrangler":
        from .operators import reshape
        return reshape.translate(self, column, direction, distance)

    # -- partitions and sets (M1-M5) -------------------------------------------
    def partition(self, fn: Callable[[Column], Column] | None = None, column=0) -> "Wrangler":
        from .operators import parts
        return parts.partition(self, fn, column)

    def union(self, other: "Wrangler") -> "Wrangler":
        from .operators import parts
        return parts.union(self, other)

    def merge_parts(self, keys: list | None = None) -> "Wrangler":
        from .operators import parts
        return parts.merge_parts(self, keys)

    # -- sinks (S4-S6) ---------------------------------------------------------
    def write_text(self, path: str, sep: str = ",", header: bool = True,
                   mode: str = "overwrite", ordered: bool | None = None) -> None:
        from .sources import sinks
        sinks.write_text(self, path, sep, header, mode, ordered)

    def write_transposed(self, path: str, sep: str = ",", block_rows: int = 1000, mode: str = "overwrite") -> None:
        from .sources import sinks
        sinks.write_transposed(self, path, sep, block_rows, mode)

    def preview(self, n: int = 20) -> str:
        from .sources import sinks
        return sinks.preview(self, n)

    def force(self) -> int:
        from .sources import sinks
        return sinks.force(self)

    def persist(self) -> "Wrangler":
        return self._with(df=self.df.persist(), same_rows=True)

    def unpersist(self) -> "Wrangler":
        return self._with(df=self.df.unpersist(), same_rows=True)


class ColumnHandle:
    """H5: verbs bound to one column."""

    #: Verbs that name their column otherwise than ``columns=``.
    ARGUMENT = {"partition": "column", "unfold": "column", "translate": "column", "fill_column": "target"}
    #: Verbs on the whole table: the handle passes them on as they are.
    TABLE = frozenset({"promote", "demote", "merge_all", "wrap_rows", "wrap_cells", "transpose", "translate_left",
                       "translate_right", "translate_up", "translate_down", "union", "merge_parts", "with_row_id",
                       "write_text", "write_transposed", "transpose_tiles", "preview", "force", "persist", "unpersist", "checkpoint", "to_df", "ordered_df"})

    def __init__(self, w: Wrangler, name: str):
        self.w, self.name = w, name

    def rename(self, name: str) -> Wrangler:
        return self.w.rename({outer(self.name): name})

    def __getattr__(self, verb: str) -> Any:
        method = getattr(self.w, verb)
        if not callable(method) or verb in self.TABLE:
            return method
        argument = self.ARGUMENT.get(verb, "columns")

        def bound(*args, **kwargs):
            if verb == "fill_column":  # w["target"].fill_column(source)
                return method(*args, **{argument: self.name, **kwargs})
            if verb == "unfold":  # w["key"].unfold(measure)
                return method(self.name, *args, **kwargs)
            if verb == "translate":  # w["v"].translate(direction, distance)
                return method(self.name, *args, **kwargs)
            if verb == "drop":
                return method(self.name)
            kwargs.setdefault(argument, self.name)
            return method(*args, **kwargs)

        return bound
