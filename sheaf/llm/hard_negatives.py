"""Hard negatives by exact inner-product search over lists shared by clusters of anchors.

Anchors are clustered by direction. For a cluster with centre c whose members lie within the
angle t of it, no member u has an inner product with a row x above ``|u| |x| cos(max(0,
angle(x, c) - t))``. So each cluster sorts the candidate rows by ``|x| cos(...)`` once, and
all its members walk that one list from the top, in chunks, until the bound of the rows left
shows that none can enter: for positives the member's k-th best score of its own label, for
negatives the last kept score of every positive's window, or the window's lower end. The
bounds are rounded up, so results are exact; scores are integers, computed exactly.

Rows are dealt by hash to shards of about ``SHARD_ROWS``, anchors by cluster to blocks of
at most ``BLOCK_ANCHORS`` (a cluster is cut where it is larger than ``CLUSTER``); one task
takes one block and one shard, so neither a hot label, nor a hot vector, nor a hot cluster
makes a task larger. A task returns at most k rows for each anchor (or window), which are
merged. The clusters' centres are fitted on about ``SAMPLE`` anchors, chosen by hash; that
sample decides the order of work, never a result.

Nulls and special cases: rows with a null id, label or vector, with a null or non-finite
component, or with a length other than the most frequent one (ties: the smaller), take no
part. A repeated row (same id, label and vector) counts once; rows that only share an id are
rows of their own, but never partners of each other. A zero vector has the score 0 with all.
Components beyond what 64-bit scores can hold raise an error. An empty table, an anchor
without a positive, or a window without a row give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick, stored

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in per cent of its positive's.
LOW, HIGH = 30, 90
SCALE = 256
SHARD_ROWS, BLOCK_ANCHORS, CLUSTER = 16384, 8192, 512
SAMPLE, CENTRES, ROUNDS = 4096, 256, 8
CHUNK = 2048
OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
#: Sums of squares below which scores are exact as doubles, and as 64-bit integers.
_EXACT_DOUBLE, _EXACT_LONG = 2.0**52, 2.0**62


def _matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0), dtype)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero for zero) and lengths."""
    x = x.astype(np.float64)
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size, size, 1)[:, None], size


def _angles(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centre, -1, 1))


def fit_centres(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on a sample: unit centres. Starts from evenly spread rows."""
    unit, size = _directions(x)
    unit = unit[size > 0]
    if not len(unit):
        return np.zeros((1, x.shape[1] if x.ndim == 2 else 0))
    centres = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        fresh, size = _directions(sums)
        centres = np.where(size[:, None] > 0, fresh, centres)
    return centres


def shared_list(x: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the order of their bound for the cluster of ``members``, and the bounds."""
    units, sizes = _directions(members)
    centre = _directions(units.sum(0)[None])[0][0]
    live = sizes > 0
    reach = float(_angles(units[live], centre).max()) if live.any() else 0.0
    unit, size = _directions(x)
    # a margin far above rounding keeps the bound safe
    bound = size * (np.cos(np.maximum(_angles(unit, centre) - reach - 1e-6, 0)) + 1e-9)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, ties to the smaller id."""
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    at = np.lexsort((ids, -scores))[:k]
    return scores[at], ids[at]


def walk(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, members: np.ndarray, member_ids: np.ndarray,
         member_labels: np.ndarray, windows: list[list[tuple[int, int]]] | None, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """All members of one cluster walk its list. Without ``windows``: the first ``k`` rows of
    each member's own label. With them: for every window (lowest, highest score) of a member
    the first ``k`` rows of other labels inside. Yields (member, window, scores, ids)."""
    order, bound = shared_list(x, members)
    x, ids, labels = x[order], ids[order], labels[order]
    size = _directions(members)[1]
    own = windows is None
    spans = [[(None, None)] for _ in members] if own else windows
    kept = [[(np.empty(0, members.dtype), np.empty(0, np.int64)) for _ in s] for s in spans]

    def floor_of(m: int) -> float:
        """The score that a row has to reach to enter any of the member's windows."""
        lows = []
        for (low, _), (s, _) in zip(spans[m], kept[m], strict=True):
            full = s[-1] if len(s) == k else -np.inf
            lows.append(full if low is None else max(low, full))
        return min(lows, default=np.inf)

    floors = np.array([floor_of(m) for m in range(len(members))])
    tops = np.array([max((h for _, h in s if h is not None), default=np.inf if own else -np.inf) for s in spans], np.float64)
    for value in (np.unique(member_labels) if own else [None]):
        # positives: each label's members walk that label's part of the list
        rows = np.flatnonzero(labels == value) if own else np.arange(len(x))
        walkers = np.flatnonzero(member_labels == value) if own else np.arange(len(members))
        at = 0
        while at < len(rows):
            limit = size[walkers] * bound[rows[at]] * (1 + 1e-12) + 1e-6
            walkers = walkers[limit >= floors[walkers]]  # the others are certified
            if not len(walkers):
                break
            part = rows[at : at + CHUNK]
            at += len(part)
            scores = members[walkers] @ x[part].T
            hit = (scores >= floors[walkers, None]) & (scores <= tops[walkers, None]) & (ids[part] != member_ids[walkers, None])
            if not own:
                hit &= labels[part] != member_labels[walkers, None]
            which, place = np.nonzero(hit)
            cuts = np.searchsorted(which, np.arange(len(walkers) + 1))
            for w, m in enumerate(walkers.tolist()):
                got = place[cuts[w] : cuts[w + 1]]
                if not len(got):
                    continue
                s, i = scores[w, got], ids[part[got]]
                for j, (low, high) in enumerate(spans[m]):
                    old_s, old_i = kept[m][j]
                    new = slice(None) if low is None else (s >= low) & (s <= high)
                    kept[m][j] = _best(np.concatenate([old_s, s[new]]), np.concatenate([old_i, i[new]]), k)
                floors[m] = floor_of(m)
    for m, found in enumerate(kept):
        for j, (s, i) in enumerate(found):
            if len(s):
                yield m, j, s, i


def _walked(rows: pa.Table, anchors: pa.Table, k: int, dtype, low: int | None, high: int | None) -> pa.Table:
    """One shard of rows against one block of anchors, cluster by cluster."""
    out: dict[str, list] = {"a": [], "p": [], "vec_id": [], "score": []}
    if rows.num_rows and anchors.num_rows:
        x, ids, labels = _matrix(rows["v"], dtype), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        u, number = _matrix(anchors["v"], dtype), anchors["a"].to_numpy()
        own_ids, own_labels, cluster = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), anchors["cluster"].to_numpy()
        positives = None if low is None else anchors["positives"].to_pylist()
        for c in np.unique(cluster):
            at = np.flatnonzero(cluster == c)
            windows = None if positives is None else [
                [(-(-low * p // 100), high * p // 100) for p in positives[i]] for i in at.tolist()]
            for m, j, s, i in walk(x, ids, labels, u[at], own_ids[at], own_labels[at], windows, k):
                out["a"].append(np.full(len(s), number[at[m]], np.int64))
                out["p"].append(np.full(len(s), j, np.int64))
                out["vec_id"].append(i)
                out["score"].append(s.astype(np.int64))
    return pa.table({name: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for name, v in out.items()})


def _clustered(batches, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        unit, _ = _directions(_matrix(b.column(b.schema.get_field_index("v"))))
        near = (unit @ centres.T).argmax(1) if len(unit) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int64))], names=[*b.schema.names, "centre"])


def _blocks(anchors: DataFrame, size: int, n: int) -> tuple[DataFrame, int]:
    """Adds ``cluster`` and ``block``; the number of blocks."""
    grain = 1 << 30
    chosen = anchors.select("v").where(F.pmod(F.xxhash64("a"), F.lit(grain)) < F.lit(min(grain, grain * SAMPLE // n))) if n > SAMPLE else anchors.select("v")
    sample = np.array([r["v"] for r in chosen.collect()], np.float64).reshape(-1, size)
    centres = fit_centres(sample, max(1, min(CENTRES, round((n / 8) ** 0.5))))
    named = anchors.mapInArrow(lambda it: _clustered(it, centres), "a bigint, vec_id bigint, label bigint, v array<double>, centre bigint")
    counts = {r["centre"]: r["count"] for r in named.groupBy("centre").count().collect()}  # at most CENTRES rows
    first, slices, clusters, filled, block = {}, {}, 0, 0, 0
    of_block = []
    for c in sorted(counts):
        slices[c], first[c] = -(-counts[c] // CLUSTER), clusters
        for _ in range(slices[c]):
            if filled + min(CLUSTER, counts[c]) > BLOCK_ANCHORS:
                block, filled = block + 1, 0
            filled += min(CLUSTER, counts[c])
            of_block.append(block)
            clusters += 1
    # one row for each cluster, at most CENTRES + n / CLUSTER
    plan = anchors.sparkSession.createDataFrame(
        [(c, s, first[c] + s, of_block[first[c] + s]) for c in slices for s in range(slices[c])],
        "centre bigint, slice bigint, cluster bigint, block bigint")
    much = anchors.sparkSession.createDataFrame(list(slices.items()), "centre bigint, slices bigint")
    cut = named.join(much, "centre").withColumn("slice", F.pmod(F.xxhash64("a"), F.col("slices")))
    return cut.join(plan, ["centre", "slice"]).drop("centre", "slice", "slices"), block + 1


def _first(found: DataFrame, k: int, *group: str) -> DataFrame:
    w = W.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Columns as ``OUT``. ``rows`` and ``anchors``: (vec_id, label, v), ``v`` an array of whole
    numbers as doubles. For each anchor and each of its first ``positives`` rows of the same
    label the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` per
    cent of the positive's."""
    spark = rows.sparkSession
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("v")
    types = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v"]
    rows, anchors = rows.where(good).select(*types), anchors.where(good).select(*types)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], OUT)
    rows, anchors = (t.where(F.size("v") == size.d) for t in (rows, anchors))
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows, anchors = rows.dropDuplicates(), anchors.dropDuplicates()
    rows = stored(rows)
    asked = stored(anchors.withColumn("a", F.monotonically_increasing_id()).select("a", "vec_id", "label", "v"))
    n, top = rows.select(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    count = asked.count()
    if not count:
        return spark.createDataFrame([], OUT)
    if (top or 0) > _EXACT_LONG:
        raise ValueError("components too large: scores would not fit 64 bits")
    dtype = np.float64 if (top or 0) <= _EXACT_DOUBLE else np.int64
    placed, blocks = _blocks(asked, size.d, count)
    placed, shards = stored(placed), max(1, -(-n // shard_rows))
    dealt = rows.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def meet(anchors: DataFrame, k: int, lo: int | None, hi: int | None) -> DataFrame:
        each = anchors.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
        return dealt.groupBy("block", "shard").cogroup(each.groupBy("block", "shard")).applyInArrow(
            lambda r, a: _walked(r, a, k, dtype, lo, hi), "a bigint, p bigint, vec_id bigint, score bigint")

    pos = stored(_first(meet(placed, positives, None, None), positives, "a").select(
        "a", (F.col("rank") - 1).cast("long").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = pos.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("p", "positive_score"))).getField("positive_score").alias("positives"))
    neg = _first(meet(placed.join(scores, "a"), negatives, low, high), negatives, "a", "p")
    names = placed.select("a", F.col("vec_id").alias("anchor_id"))
    return stored(neg.join(pos, ["a", "p"]).join(names, "a").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def finite(vec: str) -> Column:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok, F.lit(False))


def op12(vectors: DataFrame) -> DataFrame:
    # floor() makes a whole number of a NaN too, so these rows go first
    v = pick(vectors, vec_id="vec_id", label="label", e="embedding").where(finite("e")).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("e", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))
    return mine(v, v.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM base a JOIN base b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id))::INTEGER AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""
