"""Row-local verbs on Structured Streaming frames.

Row-local verbs (cut, edit, two-way split/extract, delete by predicate,
drop, merge, fill left/right/column, translate left/right, wrap_cells,
partition, fold by column names) contain no shuffle and no eager job, so they
run unchanged on a ``readStream`` frame. Verbs that need row order or an
aggregate raise a clear error on a stream; data-dependent widths must be
given (``width=``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..frame import Wrangler
from ..sources.text import split_lines


def stream_text(spark: SparkSession, path: str, cols: str | None = None,
                width: int | None = None, rows: str = "\n",
                max_files_per_trigger: int | None = None) -> Wrangler:
    """A streaming text source as an (unordered) Wrangler; ``cols`` splits each
    line into exactly ``width`` columns (required on a stream)."""
    if cols is not None and width is None:
        raise ValueError("a stream cannot discover its width: pass width=")
    reader = spark.readStream.format("text")
    if rows != "\n":
        reader = reader.option("lineSep", rows)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    w = Wrangler(reader.load(path))
    if cols is not None:
        w = split_lines(w, "value", cols, width)
    return w


def stream_table(df: DataFrame) -> Wrangler:
    """Wrap any streaming DataFrame (e.g. ``readStream.parquet``)."""
    if not df.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return Wrangler(df)


def write_stream(w: Wrangler, path: str, checkpoint: str, fmt: str = "parquet",
                 trigger: dict | None = None) -> StreamingQuery:
    """Start the stream into a file sink (exactly-once with its checkpoint)."""
    out = w.to_df()
    writer = (out.writeStream.format(fmt).option("path", path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    if w.has_part:
        writer = writer.partitionBy("_part")
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def to_memory(w: Wrangler, name: str, checkpoint: str) -> StreamingQuery:
    """Start the stream into an in-memory table (tests and previews)."""
    return (w.to_df().writeStream.format("memory").queryName(name)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())

