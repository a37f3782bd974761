"""op4: recall and exact distances against brute force."""
import numpy as np
import pytest

from sheaf.llm import ann
from sheaf.llm.common import ship


def table(spark, x, ids=None, extra=()):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [float(v) for v in r], "c", 1) for i, r in zip(ids, x, strict=True)]
    return spark.createDataFrame([*rows, *extra], "vec_id bigint, embedding array<float>, key string, t int")


def brute(x, ids, k):
    x = np.asarray(x, np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(rows)] for q, rows in out.items()}


@pytest.mark.parametrize("shard_rows", [150, 20000])
def test_recall(spark, shard_rows):
    ship(spark)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = table(spark, x)
    got = answers(ann.search(v, v.where("vec_id % 100 = 0"), shard_rows=shard_rows))
    want = brute(x, np.arange(1500), 10)
    assert set(got) == set(want) and all(len(a) == 10 for a in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    x64 = x.astype(np.float32).astype(np.float64)
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (r[1], r[0]))
        for i, s in rows:
            assert s == pytest.approx(np.sqrt(((x64[q] - x64[i]) ** 2).sum()), abs=1e-12)


def test_hot_vector_and_ties(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 8))
    x[:300] = x[0]  # a third of all rows share one vector and so one bucket in every table
    v = table(spark, x)
    got = answers(ann.search(v, v.where("vec_id % 100 = 0"), shard_rows=64))
    assert [i for i, _ in got[100]] == list(range(10)) and {s for _, s in got[100]} == {0.0}
    assert [i for i, _ in got[0]] == list(range(1, 11))


def test_rows_that_take_no_part(spark):
    ship(spark)
    x = np.eye(4)
    bad = [(100, None, "c", 1), (200, [], "c", 1), (300, [0.0] * 4, "c", 1), (400, [1.0, None, 0.0, 0.0], "c", 1),
           (500, [float("nan"), 1.0, 0.0, 0.0], "c", 1), (600, [float("inf"), 1.0, 0.0, 0.0], "c", 1),
           (700, [1.0, 2.0], "c", 1), (None, [1.0, 1.0, 1.0, 1.0], "c", 1), (2, [0.0, 0.0, 1.0, 0.0], "c", 1)]
    got = answers(ann.op4(table(spark, x, extra=bad)))
    assert got == {0: [(1, pytest.approx(2**0.5)), (2, pytest.approx(2**0.5)), (3, pytest.approx(2**0.5))]}
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert ann.op4(none).count() == 0 and ann.op4(none).columns == ["query_id", "rank", "vec_id", "score"]
    assert ann.op4(table(spark, x[:1])).count() == 0


def test_lonely_queries_are_compared_with_all_rows(spark):
    ship(spark)
    x = np.concatenate([[[1000.0] * 6], np.random.default_rng(0).standard_normal((400, 6))])
    v = table(spark, x)
    got = answers(ann.search(v, v.where("vec_id = 0"), shard_rows=100, probes=4))
    assert got[0] == [(i, pytest.approx(s)) for i, s in brute(x, np.arange(401), 10)[0]]


def test_perturbations_are_valid_and_ordered():
    sets = ann.perturbations(4, 30)
    assert len(sets) == 30 and not sets[0].any() and (sets[:, ::-1][:, :4] & sets[:, :4]).sum() == 0
    assert len({tuple(s) for s in sets.tolist()}) == 30
