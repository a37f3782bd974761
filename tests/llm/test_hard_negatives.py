"""Hard negatives against brute force over all rows."""

import math

import duckdb
import numpy as np
import pytest

from sheaf.llm import hard_negatives as hn
from sheaf.llm.queries import op12_hard_negatives

SF = "/root/testdata/sf0.001"
NAMES = "vec_id bigint, embedding array<float>, label int, a string, p int, score int, block int"


def brute(rows):
    """rows: (vec_id, embedding, label), embedding of floats as stored."""
    base, seen = [], set()
    for i, e, lab in rows:
        if i is None or e is None or lab is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        lab = int(math.fmod(lab + 1, 10)) if i % 7 == 0 else lab
        v = tuple(math.floor(256 * float(np.float32(x))) for x in e)
        if (i, lab, v) not in seen:
            seen.add((i, lab, v))
            base.append((i, lab, v))
    sizes = [len(v) for _, _, v in base]
    if sizes:
        common = min(set(sizes), key=lambda s: (-sizes.count(s), s))
        base = [r for r in base if len(r[2]) == common]
    out = []
    for a, lab, v in base:
        if a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in base if i != a), key=lambda r: r[:2])
        for s, i, _ in [r for r in scored if r[2] == lab][:5]:
            fit = [r for r in scored if r[2] != lab and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit)]
    return sorted(out)


def answers(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_brute_force_and_sql(spark):
    out = op12_hard_negatives(spark, SF)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    got = answers(out)
    assert got == brute([tuple(r) for r in rows]) and got
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.sql(hn.ORACLE).fetchall())


@pytest.mark.parametrize("shard_rows, chunk, cluster", [(64, 16, 2), (16384, 2048, 512)])
def test_clustered_vectors_ties_and_hot_vector(spark, monkeypatch, shard_rows, chunk, cluster):
    """Many short chunks, shards and cut clusters; a third of the rows share one vector."""
    monkeypatch.setattr(hn, "CHUNK", chunk)
    monkeypatch.setattr(hn, "CLUSTER", cluster)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 4)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 8))
    x = (centres[rng.integers(0, 6, 900)] + 0.1 * rng.standard_normal((900, 8))).astype(np.float32)
    x[::3] = x[0]
    rows = [(int(i), [float(v) for v in r], int(i) % 4, "x", 1, 2, 3) for i, r in enumerate(x)]
    t = spark.createDataFrame(rows, NAMES)
    v = hn.pick(t, vec_id="vec_id", label="label", e="embedding").selectExpr(
        "vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) label", "transform(e, x -> double(floor(double(x) * 256))) v")
    got = answers(hn.mine(v, v.where("vec_id % 100 = 0"), shard_rows=shard_rows))
    assert got == brute([r[:3] for r in rows]) and got


def test_rows_that_take_no_part(spark):
    e = [0.5, 0.25]
    rows = [(0, e, 1), (1, e, 1), (2, [0.4, 0.1], 2), (2, [0.4, 0.1], 2), (3, [0.3, 0.2], 3), (4, None, 1),
            (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 2), (9, e, None), (None, e, 1),
            (100, [0.0, 0.0], 1), (10, [0.1, 0.2, 0.3], 1), (11, [-0.5, -0.2], 1), (12, [0.45, 0.05], -9), (200, e, 2),
            (7, e, -1), (14, e, -11)]
    t = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], NAMES)
    assert answers(hn.op12(t)) == brute(rows)


def test_empty_and_no_anchor(spark):
    none = spark.createDataFrame([], NAMES)
    assert hn.op12(none).collect() == [] and hn.op12(none).columns[0] == "anchor_id"
    one = spark.createDataFrame([(1, [1.0], 1, "x", 1, 2, 3)], NAMES)
    assert hn.op12(one).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1, "x", 1, 2, 3)], NAMES)
    assert hn.op12(alone).collect() == []


def test_large_components(spark):
    """Scores past 2^53 are exact; past 64 bits the query says so."""
    big = float(2**21 + 1)
    rows = [(0, [big, big], 1), (1, [big, big - 256], 1), (2, [big / 2, big / 4], 2), (3, [big / 2, big / 4 + 1], 2)]
    t = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], NAMES)
    assert answers(hn.op12(t)) == brute(rows)
    t = spark.createDataFrame([(0, [1e18], 1, "x", 1, 2, 3), (1, [1e18], 1, "x", 1, 2, 3)], NAMES)
    with pytest.raises(ValueError, match="64 bits"):
        hn.op12(t)


def test_walk_is_certified_early():
    """A tight cluster far from most rows reads little of the list."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((5000, 16)), 8 + 0.05 * rng.standard_normal((200, 16))])
    x = np.floor(x * 256)
    order, bound = hn.shared_list(x, x[-20:])
    scores = x[-20:] @ x[order].T
    limit = np.sqrt((x[-20:] ** 2).sum(1))[:, None] * bound
    assert (scores <= limit + 1e-6).all() and (np.diff(bound) <= 0).all()
    fifth = np.sort(scores, axis=1)[:, -5]
    assert (limit >= fifth[:, None]).sum(1).max() < 600
