"""Token counts without ids.

Pieces are counted once for every distinct word. Each document's words then join these
counts: frequent words with the small broadcast table, where a task sums a document's
pieces as it reads them; the rest as word frequencies per document through a shuffled join.
No token ids exist at any point.

Nulls and special cases: a null text is empty (0 bytes, 0 tokens); rows with null or
repeated ids keep a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BPE, pick, stored, with_row_key
from .words import HOT_WORDS, HotTable, hot_words, measure_words, ranked, seldom, word_counts

LIMIT = 2048


def _often(batches: Iterator[pa.RecordBatch], hot: HotTable) -> Iterator[pa.RecordBatch]:
    """Per row its bytes, and the pieces of its frequent words."""
    n_ids = np.append(hot.table()["n_ids"].to_numpy(), 0)  # place -1: none
    for b, _, at, ends in ranked(batches, hot, 2):
        total = np.concatenate([[0], np.cumsum(n_ids[at])]).astype(np.int64)
        n_bytes = pc.binary_length(b.column(2)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n_bytes, pa.array(np.diff(total[ends]))],
                                         names=["id", "h", "n_bytes", "n"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE,
                 hot: int = HOT_WORDS) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row of ``docs``."""
    d = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    d = with_row_key(d)
    table = stored(measure_words(word_counts(d, "text"), tokenizer))
    top = stored(hot_words(table, hot).select("word", "n_ids"))
    rest = table.join(F.broadcast(top.select("word")), "word", "left_anti").select("word", "n_ids")
    sent, kind = HotTable(docs.sparkSession, top), d.schema["id"].dataType.simpleString()
    split = d.select("id", "h", "text")
    often = split.mapInArrow(lambda it: _often(it, sent), f"id {kind}, h bigint, n_bytes bigint, n bigint")
    far = (split.mapInArrow(lambda it: seldom(it, sent), f"id {kind}, h bigint, pos int, word string")
           .groupBy("word", "id", "h").agg(F.count(F.lit(1)).alias("f")).join(rest, "word")
           .groupBy("id", "h").agg(F.sum(F.col("f") * F.col("n_ids")).alias("n")))
    total = (often.unionAll(far.select("id", "h", F.lit(0).cast("long").alias("n_bytes"), "n")).groupBy("id", "h")
             .agg(F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")))
    return total.select("id", "n_bytes", "n_tokens")


def op8(docs: DataFrame, tokenizer: str = WORD_BPE, limit: int = LIMIT) -> DataFrame:
    t = token_counts(docs, tokenizer=tokenizer)
    return t.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
