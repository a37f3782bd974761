"""BPE encoding by a distinct-word table, decoding by an id-to-piece table.

``encode``: words are split in the tasks and counted, each distinct word is encoded once, and
ids come back to the documents by position. Occurrences of frequent words are places in a
broadcast table of bounded size; only the other occurrences travel, as (document, position),
to the word's row and with its ids back to the document. ``decode`` joins ids to pieces and
sets them in order again.

Nulls and special cases: a null text is empty (no ids); rows with null or repeated ids keep
a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD_BPE, load_tokenizer, pick, stored, with_row_key
from .words import HOT_WORDS, ID_TYPE, HotTable, encode_words, hot_words, ranked, seldom, word_counts


def _planes(ranks: np.ndarray) -> bytes:
    """Ranks (-1: not in the table) as three byte planes, which compress well."""
    u = (ranks + 1).astype("<u4")
    return zlib.compress(u.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), 1)


def _ranks(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(3, -1)
    u = np.zeros((planes.shape[1], 4), np.uint8)
    u[:, :3] = planes.T
    return u.view("<u4").ravel().astype(np.int64) - 1


def _ranked(batches: Iterator[pa.RecordBatch], hot: HotTable) -> Iterator[pa.RecordBatch]:
    for b, _, at, ends in ranked(batches, hot, 2):
        packed = [_planes(at[ends[i] : ends[i + 1]]) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(np.full(b.num_rows, -1, np.int32)), pa.array(packed, pa.binary())],
            names=["id", "h", "pos", "data"])


def _merged(batches: Iterator[pa.RecordBatch], hot: HotTable) -> Iterator[tuple]:
    """Per document ``(id, [ids of each word])`` from rows sorted by (id, h, pos): first its
    ranks, then the words that travelled."""
    ids = hot.table()["ids"].to_pylist()
    key, ranks, rest = None, None, []

    def done():
        words = iter(rest)
        return key, [ids[r] if r >= 0 else next(words) for r in ranks.tolist()]

    for b in batches:
        for i, _, pos, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if pos < 0:
                if ranks is not None:
                    yield done()
                key, ranks, rest = i, _ranks(data), []
            else:
                rest.append(data)
    if ranks is not None:
        yield done()


def encode(docs: DataFrame, finish, schema: str, id_col: str = "doc_id", text_col: str = "text",
           tokenizer: str = WORD_BPE, hot: int = HOT_WORDS) -> DataFrame:
    """Encodes every row of ``docs``. ``finish`` turns an iterator of ``(id, [ids of each
    word, packed as ID_TYPE])`` and the Arrow type of the id into record batches
    of ``schema``, in which ``{id}`` stands for that type; see ``ids_table`` and ``digests``."""
    spark = docs.sparkSession
    d = pick(docs, id=id_col, text=text_col)
    kind, arrow = d.schema["id"].dataType.simpleString(), to_arrow_type(d.schema["id"].dataType)
    d = with_row_key(d)
    table = stored(encode_words(word_counts(d, "text"), tokenizer))
    top = stored(hot_words(table, hot).select("word", "ids"))
    sent = HotTable(spark, top)
    split = d.select("id", "h", "text")
    often = split.mapInArrow(lambda it: _ranked(it, sent), f"id {kind}, h bigint, pos int, data binary")
    rest = table.select("word", "ids").join(F.broadcast(top.select("word")), "word", "left_anti")
    far = (split.mapInArrow(lambda it: seldom(it, sent), f"id {kind}, h bigint, pos int, word string")
           .join(rest, "word").select("id", "h", "pos", F.col("ids").alias("data")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = often.unionAll(far).repartition(n, "id", "h").sortWithinPartitions("id", "h", "pos")
    return both.mapInArrow(lambda it: finish(_merged(it, sent), arrow), schema.replace("{id}", kind))


def ids_table(rows: Iterator[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """``finish`` for ids themselves: ``id {id}, ids array<int>``."""
    for i, parts in rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([i], id_type), pa.array([np.frombuffer(b"".join(parts), ID_TYPE).astype(np.int32)], pa.list_(pa.int32()))],
            names=["id", "ids"])


def pieces(tokenizer: str = WORD_BPE) -> list[str]:
    """Id-to-piece table (bounded by the vocabulary)."""
    t = load_tokenizer(tokenizer)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def digests(rows: Iterator[tuple], id_type: pa.DataType, tokenizer: str = WORD_BPE, batch: int = 512) -> Iterator[pa.RecordBatch]:
    """``finish`` for digests: ``id, n_tokens, ids_sha256, decoded_sha256``. Each id joins the
    id-to-piece table, which is in memory on every worker; pieces are set in order with a
    space between, as the library decodes without a decoder."""
    piece = [p.encode() for p in pieces(tokenizer)]
    out = []

    def flush():
        cols = list(zip(*out, strict=True)) or [()] * 4
        types = (id_type, pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                          names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    for i, parts in rows:
        ids = np.frombuffer(b"".join(parts), ID_TYPE)
        raw, text = ids.astype("<u4").tobytes(), b" ".join([piece[x] for x in ids.tolist()])
        out.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest()))
        if len(out) >= batch:
            yield flush()
            out.clear()
    if out:
        yield flush()


def decode(ids: DataFrame, id_col: str = "id", ids_col: str = "ids", tokenizer: str = WORD_BPE) -> DataFrame:
    """``(id, text)`` for a table of id arrays: ids join the id-to-piece table (bounded by the
    vocabulary) and a row's pieces are put in order. Null or empty arrays give empty texts;
    rows are told apart by their number, not by ``id``."""
    spark = ids.sparkSession
    table = spark.createDataFrame(list(enumerate(pieces(tokenizer))), "piece_id int, piece string")
    d = stored(pick(ids, id=id_col, ids=ids_col).withColumn("n", F.monotonically_increasing_id()))
    each = d.select("n", F.posexplode("ids").alias("pos", "piece_id"))
    found = (each.join(F.broadcast(table), "piece_id").groupBy("n")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p")))
    text = F.array_join(F.transform("p", lambda x: x["piece"]), " ")
    return (d.select("id", "n").join(found, "n", "left")
            .select("id", F.coalesce(text, F.lit("")).alias("text")))


def op1(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    out = encode(docs, lambda rows, kind: digests(rows, kind, tokenizer),
                 "id {id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", tokenizer=tokenizer)
    return out.withColumnRenamed("id", "doc_id")
