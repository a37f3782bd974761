"""The distinct-word table: every word of a corpus once, with its token ids or their number.

A word here is a piece of text that the tokenizer never joins with its neighbours: ASCII
white space separates words and is dropped by the tokenizer, and between an ASCII letter and
a following full stop or comma its pre-tokenizer always cuts. So the ids of a text are those
of its words in order. The tokenizer lower-cases all but its special strings, so A-Z are
lower-cased here in texts in which no special string can begin: that leaves fewer words.

Words repeat by Zipf's law: ``hot_words`` takes the most frequent ones, up to a fixed number
and length, as a small table that joins without a shuffle; only the other occurrences meet
the full table through one, with no key among them that holds many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BPE, load_tokenizer

#: Kinds of bytes: white space, ASCII letters, and the marks before which a letter ends a word.
SPACE, LETTER, MARK = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
KINDS[list(b" \t\n\x0b\x0c\r")] = SPACE
KINDS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = LETTER
KINDS[list(b".,")] = MARK
#: The same for fine cuts: any ASCII punctuation is a mark, and the last byte of a Latin-1 letter,
#: which is one only after 0xC3, counts as a letter.
LATIN = 4
FINE_KINDS = KINDS.copy()
FINE_KINDS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = MARK
FINE_KINDS[0x80:0xC0] = LATIN
FINE_KINDS[[0x97, 0xB7]] = 0  # the signs of multiplication and division
#: Bytes of text that are split together.
SLICE = 8 << 20
#: Bounds of the table that is broadcast: so many words of at most so many bytes.
HOT_WORDS = 300_000
#: Ids on their way: the vocabularies of this size fit 16 bits.
ID_TYPE = "<u2"
HOT_BYTES = 24


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text begins in them, with the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    size = int(offsets[-1]) - int(offsets[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.empty(0, np.uint8)
    return data, offsets.astype(np.int64) - int(offsets[0])


def split_words(texts: pa.Array, fine: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (strings, null: empty) in order, and where those of each text begin
    among them, with the end. ``fine``: a word also ends after a Latin-1 letter, and before any
    ASCII punctuation (no pre-token goes on from a letter to one; in texts in which a special
    string can begin, only before full stops and commas): more words, fewer distinct ones."""
    data, ends = _bytes(texts.cast(pa.string()).fill_null(""))
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(ends), np.int64)
    upper = (data >= 65) & (data <= 90)
    at = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|"
    row = np.searchsorted(ends, at, side="right") - 1
    special = np.unique(row[at + 1 < ends[row + 1]]).tolist()
    for r in special:
        upper[ends[r] : ends[r + 1]] = False
    data = data + (upper.view(np.uint8) << 5)
    kind = (FINE_KINDS if fine else KINDS)[data]
    letter = kind == LETTER
    if fine:
        letter[1:] |= (kind[1:] == LATIN) & (data[:-1] == 0xC3)
        for r in special:
            kind[ends[r] : ends[r + 1]] = KINDS[data[ends[r] : ends[r + 1]]]
    space = kind == SPACE
    begins = np.empty(len(data), bool)
    begins[1:] = space[:-1] | ((kind[1:] == MARK) & letter[:-1])
    begins[ends[:-1][ends[:-1] < len(data)]] = True
    begins &= ~space
    at = np.flatnonzero(begins)
    kept = data[~space]
    offsets = np.append(at - np.cumsum(space)[at], len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(kept))
    return words, np.searchsorted(at, ends)


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about ``most`` (``SLICE``) bytes of text in column ``at``."""
    most = most or SLICE
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
            yield b.slice(start, end - start)
            start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 0):
        found = split_words(b.column(0))[0].value_counts()
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``(word, n)``: counted in each task first, so a frequent word is one row a task."""
    each = docs.select(text).mapInArrow(_counted, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


class HotTable:
    """A table of frequent words and a fact of each as Arrow columns, sent to workers once."""

    def __init__(self, spark: SparkSession, top: DataFrame):
        rows = top.toArrow().combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_table(rows)
        self.sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def table(self) -> pa.Table:
        return pa.ipc.open_stream(self.sent.value).read_all().combine_chunks()


def ranked(batches: Iterator[pa.RecordBatch], hot: HotTable, at: int) -> Iterator[tuple]:
    """Runs of rows with text in column ``at``, their words, the place of each word in the table (-1:
    none), and where the words of each row begin, with the end."""
    table = hot.table()["word"].combine_chunks()
    table = table.chunk(0) if isinstance(table, pa.ChunkedArray) else table
    for b in slices(batches, at):
        words, ends = split_words(b.column(at))
        places = pc.index_in(words.cast(table.type), value_set=table).fill_null(-1).to_numpy(zero_copy_only=False)
        yield b, words, places, ends


def seldom(batches: Iterator[pa.RecordBatch], hot: HotTable) -> Iterator[pa.RecordBatch]:
    """``(id, h, pos, word)`` of the words that are not in the table, from rows ``(id, h, text)``."""
    for b, words, places, ends in ranked(batches, hot, 2):
        far = np.flatnonzero(places < 0)
        row = np.searchsorted(ends, far, side="right") - 1
        pos = (far - ends[row]).astype(np.int32)
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(pos), words.take(pa.array(far))],
                                         names=["id", "h", "pos", "word"])


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, ids: bool) -> Iterator[pa.RecordBatch]:
    t = load_tokenizer(tokenizer)
    if ids and t.get_vocab_size(with_added_tokens=True) > np.iinfo(ID_TYPE).max + 1:
        raise ValueError("the vocabulary is too large for ID_TYPE")
    for b in batches:
        words = b.column(0).to_pylist()
        for a in range(0, len(words), 2048):
            got = [g.ids for g in t.encode_batch_fast(words[a : a + 2048], add_special_tokens=False)]
            if ids:
                out = pa.array([np.array(g, ID_TYPE).tobytes() for g in got], pa.binary())
            else:
                out = pa.array([len(g) for g in got], pa.int64())
            part = b.slice(a, len(got))
            yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*b.schema.names, "ids" if ids else "n_ids"])


def encode_words(counts: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """Adds ``ids`` (packed as ``ID_TYPE``) to a table of distinct words."""
    return counts.mapInArrow(lambda it: _encoded(it, tokenizer, True), "word string, n bigint, ids binary")


def measure_words(counts: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """Adds ``n_ids``, the number of ids, to a table of distinct words."""
    return counts.mapInArrow(lambda it: _encoded(it, tokenizer, False), "word string, n bigint, n_ids bigint")


def hot_words(table: DataFrame, limit: int = HOT_WORDS, max_bytes: int = HOT_BYTES) -> DataFrame:
    """The ``limit`` most frequent words of at most ``max_bytes`` bytes: the proven bound of
    what is broadcast. All other words go by a shuffled join."""
    return (table.where(F.octet_length("word") <= max_bytes).orderBy(F.desc("n"), "word").limit(limit))
