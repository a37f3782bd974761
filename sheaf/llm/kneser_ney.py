"""Interpolated modified Kneser-Ney language model (order 2 or 3) in sorted hash arrays.

Training counts words, then word pairs, then triples, as Spark jobs: each task sorts and
sums its own keys, cuts them into shards, and one task per shard merges and writes sorted
arrays into the model folder. Words are keyed by a 64-bit hash; a word's place in the sorted
array is its number, so a pair is the exact 64-bit key ``context number * 2^32 + word number``.
A triple lies in the shard of its first pair, as ``place of the pair in its shard * 2^32 +
word number``, also exact. Keys travel delta-coded and compressed. Workers map the arrays into memory to score texts; no part of the model passes through the
driver but shard sizes, a few sums and the list of very frequent contexts (at most four a
shard), whose pairs are dealt over shards by their second word.

Every text ends with one end token, which is scored; a context before the first word takes
part too. Probability of a word w after context v, with discounts D from counts of counts:
``max(c(v,w) - D, 0) / c(v) + g(v) * q(w)``, and q the discounted share of contexts that w
follows, with the uniform distribution over all known words and one unknown below it. An
unknown context leaves q(w).

In order 3 that is the lower level p2(w|v), with the number of different words before (v, w)
in place of c(v,w) (the count itself where v is a text's start, which nothing comes before),
and after the pair (u, v) the probability is ``max(c(u,v,w) - D, 0) / c(u,v) + g(u,v) *
p2(w|v)``. An unknown pair, and a text's first token, leave p2(w|v).

Nulls and special cases: a null text is empty (its end token is scored); a null id counts as
training; with nothing to train on every token has probability 1/(V+1) = 1.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, mounted, pick, shared_folder

FOLDS, HELD_OUT = 7, 2
#: No word holds white space, so neither key is a word's.
END = xxhash.xxh64_intdigest(b"\n")
#: Tokens sorted together before a task merges them into its counts.
BLOCK = 1 << 21
ORDERS = (2, 3)
_BITS32 = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)


def held_out(id_col: str = "id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each followed by the end token, and the number of tokens of
    each text. Bytes lower-case A-Z and split at ASCII white space only."""
    parts, sizes, end = [], np.empty(len(texts), np.int64), np.array([END], np.uint64)
    for i, t in enumerate(texts):
        n = 1
        for chunk in byte_chunks((t or "").encode()):
            raw = b"".join(map(xxhash.xxh64_digest, chunk.lower().split()))
            if raw:
                parts.append(np.frombuffer(raw, ">u8"))
                n += len(raw) // 8
        parts.append(end)
        sizes[i] = n
    return (np.concatenate(parts).astype(np.uint64) if parts else np.empty(0, np.uint64)), sizes


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their total counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


class Counter:
    """Counts of keys within a task, kept sorted; blocks merge when they outgrow the rest."""

    def __init__(self):
        self.keys, self.counts, self.fresh = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c.astype(np.int64))
        self.fresh += len(k)
        if self.fresh > max(BLOCK, len(self.keys[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = summed(self.keys, self.counts)
        self.keys, self.counts, self.fresh = [k], [c], 0
        return k, c


def _texts(batches: Iterator[pa.RecordBatch], at: int, size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about ``size`` characters of text each."""
    for b in batches:
        texts, start, room = b.column(at).to_pylist(), 0, size
        for i, t in enumerate(texts):
            room -= len(t or "") + 1
            if room <= 0 or i == len(texts) - 1:
                yield b.slice(start, i + 1 - start), texts[start : i + 1]
                start, room = i + 1, size


def _packed(keys: np.ndarray) -> bytes:
    """Keys, best sorted, as differences of their halves in compressed byte planes."""
    high, low = (keys >> _BITS32).astype("<u4"), (keys & _LOW32).astype("<u4")
    step = np.diff(high, prepend=np.uint32(0))
    same = np.concatenate([[False], (step[1:] == 0) & (low[1:] >= low[:-1])])
    move = np.where(same, low - np.concatenate([low[:1], low[:-1]]), low)
    marks = np.packbits(same)
    planes = np.concatenate([x.view(np.uint8).reshape(-1, 4).T.ravel() for x in (step, move)] + [marks])
    return len(keys).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], 8 * n + (n + 7) // 8, codec="zstd", asbytes=True), np.uint8)
    step, move = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in raw[: 8 * n].reshape(2, 4, n))
    first = np.flatnonzero(np.unpackbits(raw[8 * n :], count=n) == 0)
    total = np.cumsum(move, dtype=np.uint64)
    low = total - np.repeat(total[first] - move[first], np.diff(np.append(first, n)))
    return np.cumsum(step, dtype=np.uint32).astype(np.uint64) << _BITS32 | low


def _row(shard: int, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    big = np.flatnonzero(c >= 255)
    return pa.RecordBatch.from_pydict({
        "shard": pa.array([shard], pa.int64()), "k": pa.array([_packed(k)], pa.binary()),
        "c": pa.array([np.minimum(c, 255).astype(np.uint8).tobytes()], pa.binary()),
        "big": pa.array([np.stack([big, c[big]]).astype("<i8").tobytes()], pa.binary())})


def _dealt(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys with counts as one row of packed bytes per shard: counts below 255 take
    one byte, larger ones a place and a number."""
    if not len(keys):
        return
    order = np.argsort(shard, kind="stable")
    shards, starts = np.unique(shard[order], return_index=True)
    for s, part in zip(shards.tolist(), np.split(order, starts[1:]), strict=True):
        yield _row(s, keys[part], counts[part])


_BLOBS = "shard bigint, k binary, c binary, big binary"


def _table(rows: Iterator[pa.RecordBatch]) -> pa.Table:
    out = list(rows)
    return pa.Table.from_batches(out) if out else pa.table({
        "shard": pa.array([], pa.int64()), **{x: pa.array([], pa.binary()) for x in ("k", "c", "big")}})


def _blobs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for k, c, big in zip(t["k"].to_pylist(), t["c"].to_pylist(), t["big"].to_pylist(), strict=True):
        keys.append(_unpacked(k))
        n = np.frombuffer(c, np.uint8).astype(np.int64)
        at = np.frombuffer(big, "<i8").reshape(2, -1)
        n[at[0]] = at[1]
        counts.append(n)
    return summed(keys, counts)


def _write(folder: str, name: str, array: np.ndarray) -> None:
    """Whole file or none; a second attempt of the task writes the same bytes."""
    path = os.path.join(folder, name)
    os.makedirs(folder, exist_ok=True)
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    array.tofile(part)
    os.replace(part, path)


def _map(folder: str, name: str, dtype) -> np.ndarray:
    path = os.path.join(folder, name)
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.empty(0, dtype)
    return np.memmap(path, dtype, "r")


def _write_counts(folder: str, name: str, c: np.ndarray, small: str = "small") -> None:
    """Counts as a byte each, those from 255 on also as a place and a number."""
    big = np.flatnonzero(c >= 255)
    _write(folder, f"{name}.{small}", np.minimum(c, 255).astype(np.uint8))
    _write(folder, f"{name}.big", np.stack([big, c[big]]).astype("<i8").ravel())


class Counts:
    """Mapped counts, read at places."""

    def __init__(self, folder: str, name: str, small: str = "small"):
        self.small = _map(folder, f"{name}.{small}", np.uint8)
        self.places, self.numbers = _map(folder, f"{name}.big", "<i8").reshape(2, -1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        if not len(self.small):
            return np.zeros(len(at), np.int64)
        n = self.small[at].astype(np.int64)
        if len(self.places):
            over = np.flatnonzero(n == 255)
            n[over] = self.numbers[np.searchsorted(self.places, at[over])]
        return n


def _word_shard(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


class Words:
    """The mapped word arrays: number of a hash, or -1."""

    def __init__(self, model: dict):
        self.bits, self.base = model["bits"], np.array(model["base"], np.int64)
        self.shards = [_map(model["folder"], f"word-{s}.keys", "<u8") for s in range(1 << self.bits)]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        q, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(q), -1, np.int64)
        cuts = np.searchsorted(_word_shard(q, self.bits), np.arange((1 << self.bits) + 1))
        for s, keys in enumerate(self.shards):
            part = q[cuts[s] : cuts[s + 1]]
            if len(part) and len(keys):
                at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                out[cuts[s] : cuts[s + 1]] = np.where(keys[at] == part, at + self.base[s], -1)
        return out[back]


def _pair_shards(keys: np.ndarray, model: dict) -> np.ndarray:
    """Shard by the context's number; pairs of a very frequent context by their word."""
    n, top = 1 << model["bits"], max(model["vocabulary"], 1) + 1
    context, word = (keys >> _BITS32).astype(np.int64), (keys & _LOW32).astype(np.int64)
    return np.where(np.isin(context, model["hot"]), n + word * n // top, context * n // top)


def contexts(ids: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The number before each token; ``start`` before a text's first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    if len(ids):
        before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = start
    return before


def _count_words(batches, bits: int) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for _, texts in _texts(batches, 0):
        counter.add(hashed(texts)[0])
    k, c = counter.merge()
    yield from _dealt(k, c, _word_shard(k, bits))


def _merge_words(key: tuple, t: pa.Table, folder: str, hot: int) -> pa.Table:
    s, (k, c) = key[0].as_py(), _blobs(t)
    _write(folder, f"word-{s}.keys", k.astype("<u8"))
    _write_counts(folder, f"word-{s}", c, "counts")
    top = np.sort(np.argsort(-c, kind="stable")[:hot])
    return pa.table({"shard": [s], "n": [len(k)], "total": [int(c.sum())],
                     "at": pa.array([top.tolist()], pa.list_(pa.int64())),
                     "times": pa.array([c[top].tolist()], pa.list_(pa.int64())),
                     "ends": pa.array([c[k == END].tolist()], pa.list_(pa.int64()))})


def _count_pairs(batches, model: dict) -> Iterator[pa.RecordBatch]:
    words, counter = Words(model), Counter()
    start = model["vocabulary"]
    for _, texts in _texts(batches, 0):
        h, sizes = hashed(texts)
        ids = words.numbers(h)
        counter.add((contexts(ids, sizes, start).astype(np.uint64) << _BITS32) | ids.astype(np.uint64))
    k, c = counter.merge()
    yield from _dealt(k, c, _pair_shards(k, model))


def _merge_pairs(key: tuple, t: pa.Table, model: dict) -> pa.Table:
    s, (k, c) = key[0].as_py(), _blobs(t)
    _write(model["folder"], f"pair-{s}.keys", k.astype("<u8"))
    _write_counts(model["folder"], f"pair-{s}", c)
    return pa.table({"shard": [s], "n": [len(k)]})


class Pairs:
    """The mapped pair arrays: shard and place of a pair, and facts at these."""

    def __init__(self, model: dict):
        self.model, n = model, 2 << model["bits"]
        self.keys = [_map(model["folder"], f"pair-{s}.keys", "<u8") for s in range(n)]
        self.counts = [Counts(model["folder"], f"pair-{s}") for s in range(n)]
        self.before = [Counts(model["folder"], f"before-{s}") for s in range(n)] if model["order"] > 2 else self.counts

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard of each key, and place in it or -1."""
        q, back = np.unique(keys, return_inverse=True)
        shard, at = _pair_shards(q, self.model), np.full(len(q), -1, np.int64)
        for s, part in _by_shard(shard):
            k = self.keys[s]
            if len(k):
                place = np.minimum(np.searchsorted(k, q[part]), len(k) - 1)
                at[part] = np.where(k[place] == q[part], place, -1)
        return shard[back], at[back]

    def evidence(self, s: int, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """What the level of pairs counts: pairs themselves in order 2 and after a text's start,
        else the different words before a pair."""
        return np.where(start, self.counts[s][at], self.before[s][at])


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and the places that hold it, in order."""
    if len(shard):
        order = np.argsort(shard, kind="stable")
        present, starts = np.unique(shard[order], return_index=True)
        yield from zip(present.tolist(), np.split(order, starts[1:]), strict=True)


def _after(sizes: np.ndarray) -> np.ndarray:
    """Places of the tokens that are not a text's first."""
    inner = np.ones(int(sizes.sum()), bool)
    inner[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)] = False
    return np.flatnonzero(inner)


def _count_triples(batches, model: dict) -> Iterator[pa.RecordBatch]:
    """A row per shard for every two blocks of tokens: triples hardly repeat, so larger sums
    would take more memory and save little."""
    words, pairs, keys, shards, held = Words(model), Pairs(model), [], [], 0

    def dealt():
        k, shard = np.concatenate(keys), np.concatenate(shards)
        for s, part in _by_shard(shard):
            u, n = np.unique(k[part], return_counts=True)
            yield _row(s, u, n.astype(np.int64))

    for _, texts in _texts(batches, 0):
        h, sizes = hashed(texts)
        ids = words.numbers(h)
        before = contexts(ids, sizes, model["vocabulary"])
        last = _after(sizes)
        shard, at = pairs.find((before[last - 1].astype(np.uint64) << _BITS32) | ids[last - 1].astype(np.uint64))
        keys.append((at.astype(np.uint64) << _BITS32) | ids[last].astype(np.uint64))
        shards.append(shard.astype(np.int32))
        held += len(last)
        if held >= 2 * BLOCK:
            yield from dealt()
            keys, shards, held = [], [], 0
    if held:
        yield from dealt()


def _merge_triples(key: tuple, t: pa.Table, model: dict) -> pa.Table:
    """Writes the triples whose first pair is in a shard: words and counts, per pair the end of
    its triples and how many of them count 1 and 2. Returns, per shard of the last two words'
    pair, how many different words come before it."""
    s, (k, c) = key[0].as_py(), _blobs(t)
    folder, keys = model["folder"], _map(model["folder"], f"pair-{s}.keys", "<u8")
    at, word = (k >> _BITS32).astype(np.int64), k & _LOW32
    _write(folder, f"triple-{s}.words", word.astype("<u4"))
    _write_counts(folder, f"triple-{s}", c)
    _write(folder, f"triple-{s}.ends", np.cumsum(np.bincount(at, minlength=len(keys))).astype("<u4" if len(k) < 1 << 32 else "<u8"))
    for i, name in ((1, "once"), (2, "twice")):
        _write_counts(folder, f"{name}-{s}", np.bincount(at[c == i], minlength=len(keys)))
    u, n = np.unique((keys[at] & _LOW32) << _BITS32 | word, return_counts=True)
    return _table(_dealt(u, n.astype(np.int64), _pair_shards(u, model)))


def _merge_before(key: tuple, t: pa.Table, model: dict) -> pa.Table:
    s, (k, n) = key[0].as_py(), _blobs(t)
    keys = _map(model["folder"], f"pair-{s}.keys", "<u8")
    before = np.zeros(len(keys), np.int64)
    before[np.searchsorted(keys, k)] = n
    _write_counts(model["folder"], f"before-{s}", before)
    return pa.table({"n": [len(k)]})


def _pair_facts(batches, model: dict) -> Iterator[pa.RecordBatch]:
    """Per shard of words, from shards of pairs: by context the pairs with evidence 1, 2 and more
    and the sum of evidence, and by word its contexts, as packed bytes."""
    pairs, base = Pairs(model), np.array([*model["base"], model["vocabulary"] + 1], np.int64)
    for b in batches:
        for s in b.column(0).to_pylist():
            k = np.asarray(pairs.keys[s])
            context, word = (k >> _BITS32).astype(np.int64), (k & _LOW32).astype(np.int64)
            c = pairs.evidence(s, np.arange(len(k)), context == model["vocabulary"])
            ids = np.concatenate([context, word, context])
            kind = np.concatenate([np.minimum(c, 3), np.zeros(len(k), np.int64), np.full(len(k), 4)])
            n = np.concatenate([np.ones(2 * len(k), np.int64), c])
            u, n = summed([(ids << 3 | kind).astype(np.uint64)], [n])
            where = np.searchsorted(base, (u >> np.uint64(3)).astype(np.int64), side="right") - 1
            where = np.minimum(where, (1 << model["bits"]) - 1)  # the start context counts with the last shard
            yield from _dealt(u, n, where)


def _merge_stats(key: tuple, t: pa.Table, model: dict) -> pa.Table:
    """Aligned with a shard of words: contexts of each word, pairs of each context by evidence and
    the sum of that."""
    s, (k, n) = key[0].as_py(), _blobs(t)
    size = model["sizes"][s] + (1 if s == (1 << model["bits"]) - 1 else 0)
    at, kind = (k >> np.uint64(3)).astype(np.int64) - model["base"][s], (k & np.uint64(7)).astype(np.int64)
    stats = np.zeros((5, size), np.int64)
    stats[kind, at] = n
    for i, facts in enumerate(stats):
        _write_counts(model["folder"], f"facts{i}-{s}", facts)
    return pa.table({"seen": [np.bincount(np.minimum(stats[0], 5), minlength=6).tolist()], "types": [int(stats[0].sum())]})


def discounts(n: list[int]) -> list[float]:
    """D for counts 0, 1, 2 and 3 or more, from how many keys occur 1, 2, 3 and 4 times; where
    these are too few for the estimate, within what keeps probabilities positive."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        x = k - (k + 1) * y * b / a if a else k * 0.5
        d.append(min(max(x, 0.1 * k), 0.95 * k))
    return d


def train(docs: DataFrame, text_col: str = "text", shards: int | None = None, folder: str | None = None,
          order: int = 2) -> dict:
    """Counts all rows of ``docs`` and writes the model of ``order`` into ``folder`` (a shared mount;
    by default a new folder below spark.checkpoint.dir). Returns the model's description."""
    if order not in ORDERS:
        raise ValueError(f"order {order}: one of {ORDERS}")
    spark = docs.sparkSession
    folder = mounted(folder or shared_folder(spark))
    want = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, (want - 1).bit_length())
    n_shards = 1 << bits
    texts = pick(docs, text=text_col)
    got = (texts.mapInArrow(lambda it: _count_words(it, bits), _BLOBS).groupBy("shard")
           .applyInArrow(lambda k, t: _merge_words(k, t, folder, 16), "shard bigint, n bigint, total bigint, "
                         "at array<bigint>, times array<bigint>, ends array<bigint>").collect())
    sizes, tokens = [0] * n_shards, sum(r.total for r in got)
    for r in got:
        sizes[r.shard] = r.n
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    vocabulary = sum(sizes)
    end = [int(c) for r in got for c in r.ends]
    if vocabulary >= (1 << 32) - 1:
        raise ValueError("over 2^32 distinct words: pair keys would not be exact")
    # contexts with more tokens than an even share of a shard; at most four a shard in all
    hot = sorted(base[r.shard] + a for r in got for a, c in zip(r.at, r.times, strict=True) if c * 4 * n_shards > tokens)
    model = {"folder": folder, "order": order, "bits": bits, "sizes": sizes, "base": base, "vocabulary": vocabulary, "tokens": tokens,
             "texts": sum(end),
             "hot": np.array([*hot, vocabulary], np.int64)}
    pairs = (texts.mapInArrow(lambda it: _count_pairs(it, model), _BLOBS).groupBy("shard")
             .applyInArrow(lambda k, t: _merge_pairs(k, t, model), "shard bigint, n bigint").collect())  # a row a shard
    if order > 2:
        (texts.mapInArrow(lambda it: _count_triples(it, model), _BLOBS).groupBy("shard")
         .applyInArrow(lambda k, t: _merge_triples(k, t, model), _BLOBS).groupBy("shard")
         .applyInArrow(lambda k, t: _merge_before(k, t, model), "n bigint").agg(F.sum("n")).collect())
    each = spark.range(0, 2 * n_shards, 1, min(2 * n_shards, want))
    stats = (each.mapInArrow(lambda it: _pair_facts(it, model), _BLOBS).groupBy("shard")
             .applyInArrow(lambda k, t: _merge_stats(k, t, model), "seen array<bigint>, types bigint").collect())
    seen = np.sum([r.seen for r in stats], 0) if stats else np.zeros(6)
    model["types"] = int(sum(r.types for r in stats))
    model["word_discounts"] = discounts([int(x) for x in seen[1:5]])
    of = each.mapInArrow(lambda it: _counts_of_counts(it, model), "pairs array<bigint>, triples array<bigint>").collect()
    model["pair_discounts"] = discounts([int(x) for x in np.sum([r.pairs for r in of], 0)[1:5]])
    model["triple_discounts"] = discounts([int(x) for x in np.sum([r.triples for r in of], 0)[1:5]])
    model["seen"] = [int(x) for x in seen]
    files = spark.range(1).mapInArrow(lambda it: _listed(it, folder), "name string, size bigint").collect()  # some a shard
    model["files"] = {r.name: r.size for r in files}
    written = {f"word-{r.shard}.keys": 8 * r.n for r in got} | {f"pair-{r.shard}.keys": 8 * r.n for r in pairs}
    check_files(model["files"], written)
    return model


def _listed(batches, folder: str) -> Iterator[pa.RecordBatch]:
    """The model's files and their sizes, as one worker sees them."""
    for _ in batches:
        found = [(e.name, e.stat().st_size) for e in os.scandir(folder)] if os.path.isdir(folder) else []
        yield pa.RecordBatch.from_pydict({"name": pa.array([n for n, _ in found], pa.string()),
                                          "size": pa.array([z for _, z in found], pa.int64())})


def check_files(found: dict[str, int], wanted: dict[str, int]) -> None:
    """A missing or short file would score as an empty model: raise instead."""
    wrong = sorted(n for n, z in wanted.items() if z and found.get(n) != z)
    if wrong:
        raise FileNotFoundError(f"{len(wrong)} files of the language model are missing or of another size, the first "
                                f"{wrong[0]}: is its folder shared by the driver and all workers?")


def check_model(model: dict) -> None:
    """The files that the model was written with, as this worker sees them."""
    folder = model["folder"]
    paths = {n: os.path.join(folder, n) for n in model["files"]}
    check_files({n: os.path.getsize(p) for n, p in paths.items() if os.path.exists(p)}, model["files"])


def _counts_of_counts(batches, model: dict) -> Iterator[pa.RecordBatch]:
    pairs, total = Pairs(model), np.zeros((2, 6), np.int64)
    for b in batches:
        for s in b.column(0).to_pylist():
            context = (np.asarray(pairs.keys[s]) >> _BITS32).astype(np.int64)
            c = pairs.evidence(s, np.arange(len(context)), context == model["vocabulary"])
            total[0] += np.bincount(np.minimum(c, 5), minlength=6)
            total[1] += np.bincount(np.minimum(_map(model["folder"], f"triple-{s}.small", np.uint8), 5), minlength=6)
    kind = pa.list_(pa.int64())
    yield pa.RecordBatch.from_pydict({"pairs": pa.array([total[0].tolist()], kind), "triples": pa.array([total[1].tolist()], kind)})


class Triples:
    """The mapped triples whose first pair is in a shard."""

    def __init__(self, model: dict, s: int):
        folder = model["folder"]
        self.words, self.counts = _map(folder, f"triple-{s}.words", "<u4"), Counts(folder, f"triple-{s}")
        self.ends = _map(folder, f"triple-{s}.ends", "<u4" if len(self.words) < 1 << 32 else "<u8")
        self.once, self.twice = Counts(folder, f"once-{s}"), Counts(folder, f"twice-{s}")

    def facts(self, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Count of the triple (0 if unknown or the word is -1), and how many triples of the pair
        at ``place`` count 1, 2 and more."""
        end = self.ends[place].astype(np.int64)
        begin = np.where(place > 0, self.ends[np.maximum(place - 1, 0)], 0).astype(np.int64)
        low, high, top = begin.copy(), end.copy(), len(self.words) - 1
        while (low < high).any():
            middle = (low + high) >> 1
            less = (low < high) & (self.words[np.minimum(middle, top)] < word)
            high = np.where((low < high) & ~less, middle, high)
            low = np.where(less, middle + 1, low)
        low = np.minimum(low, top)
        known = (low < end) & (self.words[low] == word)
        one, two = self.once[place], self.twice[place]
        return np.where(known, self.counts[low], 0), one, two, end - begin - one - two


class Scorer:
    """A model's arrays mapped into a worker's memory."""

    def __init__(self, model: dict):
        check_model(model)
        self.model, self.words = model, Words(model)
        n = 1 << model["bits"]
        self.counts = [Counts(model["folder"], f"word-{s}", "counts") for s in range(n)]
        self.stats = [[Counts(model["folder"], f"facts{i}-{s}") for i in range(5)] for s in range(n)]
        self.pairs, self.triples = Pairs(model), [Triples(model, s) for s in range(2 * n)] if model["order"] > 2 else []
        self.base = np.array([*model["base"], model["vocabulary"] + 1], np.int64)

    def word_facts(self, ids: np.ndarray) -> np.ndarray:
        """Per number (sorted, distinct, not -1): count, contexts, pairs with evidence 1, 2 and more,
        and the sum of that."""
        out = np.zeros((6, len(ids)), np.float64)
        last = (1 << self.model["bits"]) - 1
        cuts = np.searchsorted(ids, self.base[:-1])
        cuts = np.concatenate([cuts, [len(ids)]])
        for s in range(last + 1):
            part = ids[cuts[s] : cuts[s + 1]] - self.base[s]
            if not len(part):
                continue
            real = part < len(self.counts[s].small)
            out[0, cuts[s] : cuts[s + 1]][real] = self.counts[s][part[real]]
            for j, facts in enumerate(self.stats[s]):
                ok = part < len(facts.small)
                out[j + 1, cuts[s] : cuts[s + 1]][ok] = facts[part[ok]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        q, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(q), np.float64)
        shard, at = self.pairs.find(q)
        start = (q >> _BITS32) == self.model["vocabulary"]
        real = np.flatnonzero(at >= 0)
        for s, part in _by_shard(shard[real]):
            part = real[part]
            out[part] = self.pairs.evidence(s, at[part], start[part])
        return out[back]

    def with_triples(self, p: np.ndarray, ids: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities after the two words before, from those after one (``p``)."""
        p, d, last = p.copy(), np.array(self.model["triple_discounts"]), _after(sizes)
        last = last[(before[last - 1] >= 0) & (ids[last - 1] >= 0)]
        shard, at = self.pairs.find((before[last - 1].astype(np.uint64) << _BITS32) | ids[last - 1].astype(np.uint64))
        real = np.flatnonzero(at >= 0)
        for s, part in _by_shard(shard[real]):
            part = real[part]
            where, place = last[part], at[part]
            total = self.pairs.counts[s][place]
            n, one, two, more = self.triples[s].facts(place, ids[where])
            left = (d[1] * one + d[2] * two + d[3] * more) / total
            p[where] = np.maximum(n - d[np.minimum(n, 3)], 0) / total + left * p[where]
        return p

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score and log10 probability."""
        m = self.model
        h, sizes = hashed(texts)
        ids = self.words.numbers(h)
        v = m["vocabulary"]
        before = contexts(ids, sizes, v)
        u, back = np.unique(np.concatenate([ids, before]), return_inverse=True)
        facts = np.zeros((6, len(u)))
        known = u >= 0
        facts[:, known] = self.word_facts(u[known])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        w, c = back[: len(ids)], back[len(ids) :]
        base = np.log10((facts[0][w] + 1) / (m["tokens"] + v + 1))
        # share of contexts, over the uniform distribution
        d = np.array(m["word_discounts"])
        q = np.full(len(u), 1 / (v + 1))
        if m["types"]:
            s = m["seen"]
            left = (d[1] * s[1] + d[2] * s[2] + d[3] * sum(s[3:])) / m["types"]
            q = (np.maximum(facts[1] - d[np.minimum(facts[1], 3).astype(int)], 0)) / m["types"] + left / (v + 1)
        p = q[w]
        d = np.array(m["pair_discounts"])
        followed = facts[2] + facts[3] + facts[4]
        total = facts[5]
        g = np.divide(d[1] * facts[2] + d[2] * facts[3] + d[3] * facts[4], total, out=np.ones(len(u)), where=total > 0)
        seen = (followed[c] > 0) & (total[c] > 0) & (before >= 0)
        n = np.zeros(len(ids))
        both = np.flatnonzero(seen & (ids >= 0))
        n[both] = self.pair_counts((before[both].astype(np.uint64) << _BITS32) | ids[both].astype(np.uint64))
        disc = np.maximum(n - d[np.minimum(n, 3).astype(int)], 0)
        p = np.where(seen, disc / np.maximum(total[c], 1) + g[c] * p, p)
        if m["order"] > 2:
            p = self.with_triples(p, ids, before, sizes)
        if not len(sizes):
            z = np.empty(0)
            return sizes, sizes, z, z
        return (sizes, np.add.reduceat((facts[0][w] > 0).astype(np.int64), starts), np.add.reduceat(base, starts),
                np.add.reduceat(np.log10(p), starts))


def _scored(batches, model: dict) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for b, texts in _texts(batches, 2):
        n, known, base, score = scorer.score(texts)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
             pa.array(np.full(len(n), model["tokens"], np.int64)), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every row. Perplexity is ``10 ** (-score / n_tokens)``."""
    d = pick(docs, id=id_col, text=text_col).select("id", held_out("id").alias("held_out"), "text")
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(lambda it: _scored(it, model), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, "
                        "train_tokens bigint, base_score double, score double")


def op6(docs: DataFrame, order: int = 3) -> DataFrame:
    training = pick(docs, id="doc_id", text="text").where(~held_out("id"))
    return score(docs, train(training, order=order)).withColumnRenamed("id", "doc_id")
