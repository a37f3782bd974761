"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables projects a vector on random Gaussian directions and cuts the
projections into slots; a bucket is the tuple of slots. A query visits its own bucket and
then the perturbed buckets in the order of their estimated success: sets of one-slot moves,
ranked once by the expected squared distance to the crossed borders, and applied to each
query by the order of its own distances to its borders. Candidates of all tables are merged
and ranked by their exact distance.

Buckets are dealt to shards; one of more than ``shard_rows`` rows is cut into several by
row, and its queries go to each, so no task holds a hot bucket. A task returns at most ``k``
rows per query. Queries that found fewer than ``k`` are compared with all rows, in blocks.
The slot width follows the spread of all vectors; nothing else is fitted.

Nulls and special cases: vectors that are null, empty, zero, or hold null or non-finite
values, and rows without an id, take no part, nor do vectors whose length differs from the
most frequent one (ties: the smaller). A repeated row (same id and vector) counts once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick, stored

K = 10
TABLES = 4
FUNCTIONS = 8
#: Slot width in standard deviations of a projection.
WIDTH = 2.5
PROBES = 128
SHARD_ROWS = 20000
SEED = 20260101


def perturbations(functions: int, probes: int) -> np.ndarray:
    """The best ``probes`` sets of border crossings as a 0/1 matrix (probes x 2 functions).
    Column j stands for the border that is j-th nearest; its expected squared distance is
    that of the j-th order statistic of uniform offsets, and j and its mirror are the two
    borders of one slot, so no set holds both."""
    m = functions
    j = np.arange(1, 2 * m + 1)
    low, mirror = j * (j + 1) / (4 * (m + 1) * (m + 2)), 2 * m + 1 - j
    cost = np.where(j <= m, low, 1 - mirror / (m + 1) + mirror * (mirror + 1) / (4 * (m + 1) * (m + 2)))
    sets: list[tuple[int, ...]] = [()]
    queue = [(cost[0], (0,))]
    while queue and len(sets) < probes:
        c, s = heapq.heappop(queue)
        if not any(2 * m - 1 - x in s for x in s):
            sets.append(s)
        nxt = s[-1] + 1
        if nxt < 2 * m:
            heapq.heappush(queue, (c - cost[s[-1]] + cost[nxt], (*s[:-1], nxt)))
            heapq.heappush(queue, (c + cost[nxt], (*s, nxt)))
    out = np.zeros((len(sets), 2 * m), np.int64)
    for i, s in enumerate(sets):
        out[i, list(s)] = 1
    return out


class Hashes:
    """The tables' random projections; made from the seed, so every task has the same."""

    def __init__(self, centre: np.ndarray, spread: float, tables: int, functions: int, width: float, seed: int = SEED):
        rng = np.random.default_rng(seed)
        a = rng.standard_normal((tables, len(centre), functions))
        self.a = a / np.linalg.norm(a, axis=1, keepdims=True)
        self.centre, self.w = centre, width * (spread or 1.0)
        self.b = rng.uniform(0, 1, (tables, functions))
        self.mix = rng.integers(1, 1 << 62, (tables, functions)) * 2 + 1
        self.salt = rng.integers(1, 1 << 62, tables)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Positions in slots: tables x rows x functions."""
        return (x - self.centre) @ self.a / self.w + self.b[:, None, :]

    def keys(self, slots: np.ndarray, table: int) -> np.ndarray:
        """One number per tuple of slots (equal tuples, equal numbers)."""
        return (slots.astype(np.int64) * self.mix[table]).sum(-1) + self.salt[table]

    def probes(self, x: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """Bucket numbers that each row visits, nearest first: rows x tables x probes."""
        m = self.a.shape[2]
        out = np.empty((len(x), len(self.a), len(sets)), np.int64)
        for t, f in enumerate(self.places(x)):
            slot = np.floor(f)
            off = f - slot
            order = np.argsort(np.concatenate([off, 1 - off], 1), axis=1, kind="stable")  # lower borders, upper borders
            step = np.where(order < m, -1, 1) * self.mix[t][order % m]
            out[:, t] = self.keys(slot, t)[:, None] + step @ sets.T
        return out


def usable(vec: str, size: int | None = None) -> Column:
    c = F.col(vec)
    ok = (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = ok & F.exists(c, lambda x: x != 0)
    return F.coalesce(ok if size is None else ok & (F.size(c) == size), F.lit(False))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _sums(batches) -> Iterator[pa.RecordBatch]:
    n, s, q = 0, 0.0, 0.0
    for b in batches:
        x = _matrix(b.column(0))
        if len(x):
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
    if n:
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()], pa.list_(pa.float64())),
                                          "q": pa.array([q.tolist()], pa.list_(pa.float64()))})


def _keyed(batches, hashes: Hashes) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _matrix(b.column(1))
        if not len(x):
            continue
        for t, f in enumerate(hashes.places(x)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), t, np.int32)), pa.array(hashes.keys(np.floor(f), t)), b.column(0), b.column(1)],
                names=["t", "key", "vec_id", "vec"])


def _spread_of(keys: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    """Into how many shards each bucket is cut."""
    if not hot:
        return np.ones(len(keys), np.int64)
    known = np.array(sorted(hot), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, np.array([hot[k] for k in known.tolist()], np.int64)[at], 1)


def _shard(keys: np.ndarray, slice_no: np.ndarray, shards: int) -> np.ndarray:
    x = keys.astype(np.uint64) + slice_no.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(shards)).astype(np.int64)


def _sharded(batches, hot: dict[int, int], shards: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, ids = b.column(1).to_numpy(), b.column(2).to_numpy()
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        s = _shard(keys, (mixed.astype(np.int64) % _spread_of(keys, hot)), shards)
        yield pa.RecordBatch.from_arrays([pa.array(s), *b.columns], names=["shard", *b.schema.names])


def _asked(batches, hashes: Hashes, sets: np.ndarray, hot: dict[int, int], shards: int, everywhere: bool) -> Iterator[pa.RecordBatch]:
    """A query once for each shard that holds a bucket it visits, with those buckets."""
    for b in batches:
        for a in range(0, b.num_rows, 256):
            part = b.slice(a, min(256, b.num_rows - a))
            x = _matrix(part.column(1))
            if everywhere:
                probes = np.zeros((len(x), 0), np.int64)
            else:
                probes = hashes.probes(x, sets).reshape(len(x), -1)
            rows, at, where = [], [], []
            for i, p in enumerate(probes):
                if everywhere:
                    s = np.arange(shards)
                    cuts, p = np.zeros(shards, np.int64), np.empty(0, np.int64)
                    which = s
                else:
                    n = _spread_of(p, hot)
                    p = np.repeat(p, n)
                    first = np.cumsum(n) - n
                    s = _shard(p, np.arange(len(p)) - np.repeat(first, n), shards)
                    order = np.argsort(s, kind="stable")
                    p, s = p[order], s[order]
                    which, cuts = np.unique(s, return_index=True)
                for w, q in zip(which.tolist(), np.split(p, cuts[1:]), strict=True):
                    at.append(i)
                    where.append(w)
                    rows.append(q.tobytes())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), part.column(0).take(take), part.column(1).take(take),
                                              pa.array(rows, pa.binary())], names=["shard", "query_id", "vec", "probes"])


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of ``x``: their ids and exact distances, ties to smaller ids."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    if len(d) > 4 * k:
        keep = d <= np.partition(d, k - 1)[k - 1]
        d, ids = d[keep], ids[keep]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def _answered(index: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    out_q, out_v, out_d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    if index.num_rows and asked.num_rows:
        index, asked = index.combine_chunks(), asked.combine_chunks()
        keys, ids, t = index["key"].to_numpy(), index["vec_id"].to_numpy(), index["t"].to_numpy()
        x = _matrix(index["vec"].combine_chunks())
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        qs = _matrix(asked["vec"].combine_chunks())
        for q, qid, raw in zip(qs, asked["query_id"].to_pylist(), asked["probes"].to_pylist(), strict=True):
            p = np.frombuffer(raw, np.int64)
            if len(p):
                a, b = np.searchsorted(sorted_keys, p, "left"), np.searchsorted(sorted_keys, p, "right")
                rows = np.concatenate([order[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True) if j > i] or [order[:0]])
            else:
                rows = np.flatnonzero(t == 0)
            rows = rows[ids[rows] != qid]
            rows = rows[np.unique(ids[rows], return_index=True)[1]] if len(rows) else rows
            v, d = nearest(q, x[rows], ids[rows], k) if len(rows) else (rows, np.empty(0))
            out_q.append(np.full(len(v), qid, np.int64))
            out_v.append(v)
            out_d.append(d)
    return pa.table({"query_id": np.concatenate(out_q).astype(np.int64), "vec_id": np.concatenate(out_v).astype(np.int64),
                     "score": np.concatenate(out_d).astype(np.float64)})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
           tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES,
           shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its ``k`` nearest found
    among the other rows of ``vectors``; both have the columns ``id_col`` and ``vec_col``."""
    schema = "query_id bigint, vec_id bigint, score double"
    base = pick(vectors, vec_id=id_col, vec=vec_col)
    size = (base.where(usable("vec")).groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first())
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    good = base.where(usable("vec", size.d) & F.col("vec_id").isNotNull()).withColumn("vec_id", F.col("vec_id").cast("long"))
    ask = pick(queries, query_id=id_col, vec=vec_col)
    ask = ask.where(usable("vec", size.d) & F.col("query_id").isNotNull()).withColumn("query_id", F.col("query_id").cast("long"))
    parts = good.select("vec").mapInArrow(_sums, "n bigint, s array<double>, q array<double>").collect()
    n = sum(p.n for p in parts)
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    centre = np.sum([p.s for p in parts], 0) / n
    spread = float(np.sqrt(max(np.mean(np.sum([p.q for p in parts], 0) / n - centre**2), 0.0)))
    hashes, sets = Hashes(centre, spread, tables, functions, width), perturbations(functions, probes)
    kind = good.schema["vec"].dataType.simpleString()
    keyed = good.mapInArrow(lambda it: _keyed(it, hashes), f"t int, key bigint, vec_id bigint, vec {kind}")
    # buckets beyond a shard's rows: at most tables * n / shard_rows of them
    large = keyed.groupBy("key").count().where(F.col("count") > shard_rows).collect()
    hot = {r["key"]: -(-r["count"] // shard_rows) for r in large}
    shards = max(1, -(-n * tables // shard_rows))
    index = keyed.mapInArrow(lambda it: _sharded(it, hot, shards), f"shard bigint, t int, key bigint, vec_id bigint, vec {kind}")

    def answers(q: DataFrame, everywhere: bool) -> DataFrame:
        asked = q.mapInArrow(lambda it: _asked(it, hashes, sets, hot, shards, everywhere),
                             f"shard bigint, query_id bigint, vec {kind}, probes binary")
        found = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(
            lambda a, b: _answered(a, b, k), schema)
        return _ranked(found, k)

    first = stored(answers(ask, False))
    enough = first.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select("query_id")
    short = ask.join(enough, "query_id", "left_anti")
    if short.isEmpty():
        return first
    return first.join(enough, "query_id", "left_semi").unionAll(answers(short, True))


def op4(vectors: DataFrame) -> DataFrame:
    v = pick(vectors, vec_id="vec_id", embedding="embedding")
    return search(v, v.where(F.col("vec_id") % 100 == 0))
