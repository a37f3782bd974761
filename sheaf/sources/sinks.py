"""Sinks (S4-S6): every write runs on the executors; nothing goes through the driver."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..frame import PART, Wrangler
from ..operators.reshape import transpose_tiles
from ..plans.order import sort_keys


def write_text(w: Wrangler, path: str, sep: str = ",", header: bool = True,
               mode: str = "overwrite", ordered: bool | None = None) -> None:
    """One line per row, cells joined by ``sep`` (no quoting); the header is the first
    line of the table, that is of the first file in name order (with a partition key, of each
    key's folder). Read back as a text source, a folder gives header and rows as they were,
    blank lines included.

    ``ordered`` (default: when the table has a row order) keeps the row order across the
    output files, through a range-partitioned (sampled) sort.
    """
    line = F.concat_ws(sep, *[F.coalesce(w.text(c), F.lit("")) for c in w.cells])
    src = w.df
    if (w.order if ordered is None else ordered) and w.order:
        src = src.orderBy(*w.part_cols, *sort_keys(w))
    df = src.select(line.alias("value"), *w.part_cols)
    if header:
        names = F.lit(sep.join(w.columns)).alias("value")
        if w.has_part:
            top = w.df.select(*w.part_cols).distinct().select(names, *w.part_cols)
        else:
            top = w.spark.range(0, 1, 1, 1).select(names)
        df = top.union(df)  # the partitions of a union keep their order: the header's is the first
    writer = df.write.mode(mode)
    if w.has_part:
        writer = writer.partitionBy(PART)
    writer.text(path)


def write_transposed(w: Wrangler, path: str, sep: str = ",", block_rows: int = 1000, mode: str = "overwrite") -> None:
    """W8 for a table of any length: each column becomes one line of text, which no task or cell
    ever holds whole. Folder ``row=i`` holds the line of column ``i``: its files in name order, each
    of them tiles of ``block_rows`` cells in order, and ``sep`` behind every tile."""
    tiles = transpose_tiles(w, block_rows)
    line = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), sep).alias("value")
    df = tiles.df.orderBy("row", "block").select(line, "row")
    df.write.mode(mode).partitionBy("row").option("lineSep", sep).text(path)


def preview(w: Wrangler, n: int = 20) -> str:
    """Header plus the first ``n`` rows in order (bounded: a top-k)."""
    rows = w.ordered_df(with_part=False).limit(n).collect()
    lines = [",".join(w.columns)] + [",".join("" if v is None else str(v) for v in r) for r in rows]
    return "\n".join(lines)


def force(w: Wrangler) -> int:
    """Run the whole plan now, every cell of it; returns the row count."""
    seen = Observation()
    shown = w.to_df().observe(seen, F.count(F.lit(1)).alias("n"))
    shown.write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def run_noop(w: Wrangler) -> None:
    """Run the whole plan with the ``noop`` sink (for timing)."""
    w.to_df().write.format("noop").mode("overwrite").save()
