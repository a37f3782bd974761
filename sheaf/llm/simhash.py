"""SimHash near-duplicates over a Gray-order hierarchical index.

1. A 64-bit fingerprint per document: a bit is set if it is set in over half of the hashes
   of the text's word shingles (repeats included).
2. Equal fingerprints collapse, so a group of exact copies is one index entry, however many.
3. The entries are cut into ranges of the Gray order. Each range is an upper node (mask and
   pattern of its shared bits); the tree over these upper nodes routes every entry to the
   later ranges that may hold a partner, and prunes all other ranges at once.
4. In each range, the tree over its entries finds all partners within ``distance`` bits. A
   task returns a spanning forest of its links, never all pairs of a dense group: subtrees
   already joined to the query's component are pruned as well.
5. Connected components of the forests, smallest document id as label.

Nulls and special cases: a null text counts as empty; a text without words has fingerprint
zero and links like any other; documents with a null id keep their row, but never name a
component (which is null if no member has an id). Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, pick, stored
from .components import components
from .gray_index import GrayTree, Unions, gray_rank

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Entries of one range of the index (bounds a task; more entries make more ranges).
RANGE_ROWS = 131072
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens).tolist()
    ends = ends[shingle - 1 :].tolist() if len(words) > shingle else [len(joined)]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for a in range(0, len(ends), _BLOCK):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[a:], ends[a : a + _BLOCK], strict=False)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(ends))
    return int.from_bytes(bits.tobytes(), "big")


def _prints(batches: Iterator[pa.RecordBatch], at: int, shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t, shingle) for t in b.column(at).to_pylist()), np.uint64, b.num_rows)
        keep = [c for i, c in enumerate(b.columns) if i != at]
        names = [n for i, n in enumerate(b.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(fp.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` with the fingerprint's bits as a signed long."""
    d = pick(docs, id=id_col, text=text_col)
    return d.mapInArrow(lambda it: _prints(it, 1, shingle), f"id {d.schema['id'].dataType.simpleString()}, fp bigint")


def _unsigned(c: pa.Array) -> np.ndarray:
    return c.to_numpy(zero_copy_only=False).view(np.uint64)


def _ranged(batches, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Range number of each fingerprint; bounds are Gray ranks."""
    for b in batches:
        fp = _unsigned(b.column(0))
        r = np.searchsorted(bounds, gray_rank(fp), side="right")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r.astype(np.int64))], names=["fp", "r"])


def _routed(batches, low: np.ndarray, high: np.ndarray, ids: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Each entry to its own range and, as a visitor, to later ranges that may hold partners."""
    tree = GrayTree(low, high)
    for b in batches:
        fp, own = _unsigned(b.column(0)), b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(np.ones(len(fp), bool))],
                                         names=["r", "fp", "member"])
        for q, node in tree.near(fp, limit):
            r = ids[node]
            later = r > own[q]
            q, r = q[later], r[later]
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(fp[q].view(np.int64)),
                                                  pa.array(np.zeros(len(q), bool))], names=["r", "fp", "member"])


def forest(members: np.ndarray, visitors: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among ``members`` and from ``visitors`` to them."""
    members = members[np.argsort(gray_rank(members))]
    every = np.concatenate([members, visitors])
    tree, sets = GrayTree(members, members), Unions(len(every))
    chunk = 4096
    for a in range(0, len(every), chunk):
        root = sets.roots()
        uniform = tree.uniform(root[: len(members)])

        def joined(level, q, node, a=a, root=root, uniform=uniform):
            return uniform[level][node] == root[q + a]

        for q, node in tree.near(every[a : a + chunk], limit, joined):
            sets.merge(q + a, node)
    root = sets.roots()
    moved = np.flatnonzero(root != np.arange(len(every)))
    return every[moved], every[root[moved]]


def _linked(table: pa.Table, limit: int) -> pa.Table:
    fp, member = _unsigned(table["fp"].combine_chunks()), table["member"].to_numpy()
    u, v = forest(np.unique(fp[member]), np.unique(fp[~member]), limit)
    return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})


def links(entries: DataFrame, distance: int = DISTANCE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``entries`` has one distinct ``fp`` a row. Returns edges ``(u, v)`` that connect
    exactly what the pairs within ``distance`` bits connect."""
    e = entries.select("fp")
    n = e.count()
    n_ranges = max(1, -(-n // range_rows))
    # quantiles of the Gray rank; read as signed so that the order is the unsigned one
    top = F.col("fp")
    for k in (1, 2, 4, 8, 16, 32):
        top = top.bitwiseXOR(F.shiftrightunsigned(top, k))
    signed = (top.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))).cast("double")
    cuts = []
    if n_ranges > 1:
        cuts = e.select(signed.alias("x")).approxQuantile("x", [i / n_ranges for i in range(1, n_ranges)], 0.1 / n_ranges)
    bounds = np.unique(np.array([min(max(int(c), -(1 << 63)), (1 << 63) - 1) + (1 << 63) for c in cuts], dtype=np.uint64))
    ranged = e.mapInArrow(lambda it: _ranged(it, bounds), "fp bigint, r bigint")
    nodes = ranged.groupBy("r").agg(F.bit_and("fp").alias("lo"), F.bit_or("fp").alias("hi")).orderBy("r").collect()
    ids = np.array([x.r for x in nodes], np.int64)
    low = np.array([x.lo for x in nodes], np.int64).view(np.uint64)
    high = np.array([x.hi for x in nodes], np.int64).view(np.uint64)
    routed = ranged.mapInArrow(lambda it: _routed(it, low, high, ids, distance), "r bigint, fp bigint, member boolean")
    return routed.groupBy("r").applyInArrow(lambda t: _linked(t, distance), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row: the id, ``fp`` (signed bits) and ``component``, the smallest id that links reach."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    entries = stored(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(entries, distance, range_rows))
    grouped = entries.join(roots, entries.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component"))
    label = grouped.join(smallest, "root").select("fp", "component")
    return prints.join(label, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One document of each group (that with the smallest id, one of its rows if it is
    repeated), all columns as they are. Groups without any id keep one row."""
    rid = fresh(docs, "row_no")
    numbered = stored(docs.withColumn(rid, F.monotonically_increasing_id()))
    found = near_duplicates(_with_order(numbered, id_col, rid), "id", text_col, **params)
    best = found.groupBy("component").agg(F.min("id").alias("id")).select(F.col("id.n").alias(rid))
    return numbered.join(best, rid, "left_semi").select(*[col(c) for c in docs.columns])


def _with_order(docs: DataFrame, id_col: str, rid: str) -> DataFrame:
    """Ids ordered as (null last, id, row number): unique, so that one row wins."""
    return docs.withColumn("id", F.struct(col(id_col).isNull().alias("e"), col(id_col).alias("k"), col(rid).alias("n")))


def op3(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))
