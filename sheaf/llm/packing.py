"""Best-fit packing under several capacities at once.

A document becomes its token ids and one end id; only a document longer than a sequence is
cut, into full pieces and a last one. Pieces are dealt at random into groups of a bounded
number of pieces; a group is packed in one task by vector best fit: pieces in falling
order, each into the open sequence that has room in every dimension (tokens, documents,
attention cost = sum of squared lengths) and whose weighted residual fits best. Groups only
cost about one unfilled sequence each. Ids never leave the task that makes them: a piece
carries its length and checksum.

Nulls and special cases: a null or empty text is the end id alone; rows with null or
repeated ids are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BPE, byte_chunks, load_tokenizer, pick, stored
from .words import slices, split_words

CAPACITY = 4096
END_ID = 1
#: Pieces packed together in one task.
GROUP_PIECES = 20000
#: Words whose ids a worker keeps, in each of two generations.
CACHE_WORDS = 500_000
#: New words of letters that are encoded as one text.
LINE = 256
#: Bytes of texts that are looked up together; a longer text goes in chunks.
TOGETHER = 2 << 20

#: Words that are one pre-token: ASCII and Latin-1 letters.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class WordIds:
    """Ids of texts as little-endian 32-bit integers, by their distinct words and through a
    bounded cache of two generations: when the young one is full it becomes the old one, and
    what is used again moves back."""

    def __init__(self, tokenizer: str = WORD_BPE, keep: int = CACHE_WORDS):
        self.tokenizer, self.keep, self.known, self.old = load_tokenizer(tokenizer), keep, {}, {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        if suffix:
            self.last[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True

    def _each(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word, encoded as a text of its own."""
        for a in range(0, len(words), 4096):
            for g in self.tokenizer.encode_batch_fast(words[a : a + 4096], add_special_tokens=False):
                yield np.array(g.ids, "<u4").tobytes()

    def _lines(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word, many words encoded as one text with spaces between. Every word is
        one pre-token, so its ids end at the only one among them that ends a pre-token."""
        lines = [words[a : a + LINE] for a in range(0, len(words), LINE)]
        for a in range(0, len(lines), 16):
            some = lines[a : a + 16]
            got = self.tokenizer.encode_batch_fast([" ".join(x) for x in some], add_special_tokens=False)
            for line, g in zip(some, got, strict=True):
                ids = np.array(g.ids, "<u4")
                ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
                if len(ends) != len(line):  # a vocabulary that does not mark them
                    yield from self._each(line)
                    continue
                raw, at = ids.tobytes(), 0
                for end in ends:
                    yield raw[at:end]
                    at = end

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of ``words`` into the young generation."""
        known, old, letters, others = self.known, self.old, [], []
        for w in words:
            if w in old:
                known[w] = old[w]
            else:
                (letters if _LETTERS.fullmatch(w) else others).append(w)
        known.update(zip(letters, self._lines(letters), strict=True))
        known.update(zip(others, self._each(others), strict=True))

    def many(self, texts: pa.Array) -> list[bytes]:
        found, ends = split_words(texts, fine=True)
        found = found.dictionary_encode()
        words = found.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.keep:
            self.known, self.old = {}, self.known
            new = words
        self._learn(new)
        ids = pa.array([self.known[w] for w in words], pa.large_binary()).take(found.indices)
        if not len(ids):
            return [b""] * len(texts)
        places, data = np.frombuffer(ids.buffers()[1], np.int64)[ends].tolist(), memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:z]) for a, z in zip(places[:-1], places[1:], strict=True)]

    def __call__(self, text: bytes) -> bytes:
        return self.many(pa.array([text.decode()]))[0]


_IDS: dict[str, WordIds] = {}


def word_ids(tokenizer: str) -> WordIds:
    if tokenizer not in _IDS:
        _IDS[tokenizer] = WordIds(tokenizer)
    return _IDS[tokenizer]


def cut_pieces(parts: Iterator[bytes], capacity: int, end_id: int) -> Iterator[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32 of the ids)`` of one document; ``parts`` are its ids in
    chunks, so a very long document is never whole in memory."""
    size, buf, piece = 4 * capacity, b"", 0
    for part in parts:
        buf += part
        whole = 0
        while len(buf) - whole > size:
            yield piece, piece * capacity, capacity, zlib.crc32(buf[whole : whole + size])
            piece += 1
            whole += size
        buf = buf[whole:]
    buf += int(end_id).to_bytes(4, "little")
    for a in range(0, len(buf), size):
        part = buf[a : a + size]
        yield piece, piece * capacity, len(part) // 4, zlib.crc32(part)
        piece += 1


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    ids = word_ids(tokenizer)
    for b in slices(batches, 1, TOGETHER):
        texts = b.column(1).fill_null("")
        if b.num_rows == 1 and pc.binary_length(texts)[0].as_py() > TOGETHER:
            found = [map(ids, byte_chunks(texts[0].as_py().encode()))]
        else:
            found = [iter([x]) for x in ids.many(texts)]
        rows = [(i, *p) for i, parts in enumerate(found) for p in cut_pieces(parts, capacity, end_id)]
        at, *cols = zip(*rows, strict=True)
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, types, strict=True)]],
            names=["id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE,
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    d = pick(docs, id=id_col, text=text_col)
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end_id),
                        f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, rule: str = "residual",
             weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)) -> tuple[np.ndarray, np.ndarray]:
    """Vector best fit of pieces of ``lengths`` in falling order: ``(sequence, offset)`` of
    each. ``rule`` "residual" takes the feasible sequence with the smallest weighted norm of
    what is left after the piece; "dot" that with the largest weighted product of the piece
    and the room. Room and piece are measured in shares of each capacity. A piece that alone
    breaks a capacity raises."""
    n = len(lengths)
    seq, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    if not n:
        return seq, offset
    size = np.stack([lengths, np.ones(n, np.int64), lengths * lengths]).astype(np.float64)
    cap = np.array([capacity, max_docs, max_cost], np.float64)
    if (size > cap[:, None]).any():
        raise ValueError("a piece exceeds a capacity of an empty sequence")
    w = np.asarray(weights) / cap**2
    smallest = float(lengths.min())
    room, bins, used, n_open, n_bins = np.empty((3, 1024)), np.empty(1024, np.int64), np.zeros(n, np.int64), 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        x = size[:, i]
        r = room[:, :n_open]
        fits = np.flatnonzero((r[0] >= x[0]) & (r[1] >= x[1]) & (r[2] >= x[2]))
        if len(fits):
            c = r[:, fits]
            if rule == "dot":
                k = fits[np.argmax((w * x) @ c)]
            else:
                k = fits[np.argmin(w @ (c - x[:, None]) ** 2)]
            room[:, k] -= x
        else:
            if n_open == room.shape[1]:
                room, bins = np.concatenate([room, np.empty_like(room)], 1), np.concatenate([bins, bins])
            k = n_open
            room[:, k], bins[k] = cap - x, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        b = bins[k]
        seq[i], offset[i] = b, used[b]
        used[b] += lengths[i]
        if (room[:, k] < (smallest, 1, smallest * smallest)).any():  # nothing fits any more: close it
            n_open -= 1
            room[:, k], bins[k] = room[:, n_open], bins[n_open]
    return seq, offset


def _packed(t: pa.Table, capacity: int, max_docs: int, max_cost: int, rule: str, weights) -> pa.Table:
    t = t.combine_chunks().sort_by([("length", "descending"), ("n", "ascending")])
    seq, offset = best_fit(t["length"].to_numpy(), capacity, max_docs, max_cost, rule, weights)
    g = t["g"].to_numpy()
    out = t.drop_columns(["g", "n"])
    return (out.append_column("sequence_id", pa.array((g << 32) + seq))
            .append_column("offset", pa.array(offset)))


def pack(piece_df: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None,
         rule: str = "residual", weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6),
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces with a ``length`` each.
    Without ``max_docs`` and ``max_cost`` these two bind no more than the tokens do."""
    max_docs, max_cost = max_docs or capacity, max_cost or capacity * capacity
    p = stored(piece_df.withColumn("n", F.monotonically_increasing_id()))
    groups = max(1, -(-p.count() // group_pieces))
    dealt = p.withColumn("g", F.pmod(F.xxhash64("n"), F.lit(groups)))
    ddl = ", ".join(f"`{n}` {t}" for n, t in piece_df.dtypes) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("g").applyInArrow(lambda t: _packed(t, capacity, max_docs, max_cost, rule, weights), ddl)


def op9(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    return pack(pieces(docs, tokenizer=tokenizer)).withColumnRenamed("id", "doc_id")
