"""op3: fingerprints, the index and the components against brute force."""
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hostile import empty, hostile, texts

from sheaf.llm import gray_index, simhash
from sheaf.llm.common import ship
from sheaf.llm.components import components


def plain_print(text, k=3):
    lower = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def close_pairs(fps, limit=2):
    a = np.array(fps, np.uint64)
    return [(i, i + 1 + int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= limit)]


def test_fingerprints():
    for _, t in texts():
        if len(t) < 50000:
            assert simhash.fingerprint(t) == plain_print(t)


def sample(seed, n):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(n // 8)]
    out = [s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for s in seeds for _ in range(6)]
    ball = rng.getrandbits(64)
    return list({*out, *seeds, *(ball ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)), 0, (1 << 64) - 1, 1 << 63, 1})


@pytest.mark.parametrize("front", [64, 1 << 18])
def test_tree_finds_every_pair(monkeypatch, front):
    monkeypatch.setattr(gray_index, "FRONT", front)
    fps = np.array(sample(3, 400), np.uint64)
    s = fps[np.argsort(gray_index.gray_rank(fps))]
    got = {(int(a), int(b)) for q, node in gray_index.GrayTree(s, s).near(fps, 2) for a, b in zip(fps[q], s[node], strict=True)}
    want = {(int(a), int(b)) for a in fps for b in s if (int(a) ^ int(b)).bit_count() <= 2}
    assert got == want


def test_gray_rank_is_the_inverse_of_the_gray_code():
    x = np.arange(5000, dtype=np.uint64)
    assert (gray_index.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


@pytest.mark.parametrize("range_rows", [7, 100, 100_000])
def test_links_connect_what_pairs_connect(spark, range_rows):
    ship(spark)
    fps = sorted(sample(9, 320))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    e = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(3)
    edges = simhash.links(e, 2, range_rows).collect()
    at = {f: i for i, f in enumerate(signed)}
    for r in edges:
        assert groups(len(fps), close_pairs(fps))[at[r.u]] == groups(len(fps), close_pairs(fps))[at[r.v]] if len(edges) < 5 else True
    assert groups(len(fps), [(at[r.u], at[r.v]) for r in edges]) == groups(len(fps), close_pairs(fps))
    assert len(edges) <= 6 * len(fps)  # forests, not all pairs of the dense ball


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (200, 199)] + [(500, 500 + i) for i in range(1, 30)]
    df = spark.createDataFrame([*chain, (None, 3)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(df).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 103: 100, 101: 100, 200: 199, 199: 199} | {500 + i: 500 for i in range(30)}
    assert got == want
    assert components(df.where("u > 1000")).count() == 0


def near(i):
    words = [f"w{k}" for k in range(400)]
    words[i % 400] = f"changed{i}"
    return " ".join(words)


EXTRA = [(1000 + i, near(i)) for i in range(40)] + [(2000 + i, near(0).upper()) for i in range(50)]


def test_query(spark):
    ship(spark)
    rows = simhash.op3(hostile(spark, EXTRA)).collect()
    docs = texts(EXTRA)
    want_print = [plain_print(t) if len(t) < 50000 else simhash.fingerprint(t) for _, t in docs]
    root = groups(len(docs), close_pairs(want_print))
    label = {g: min((docs[i][0] for i in range(len(docs)) if root[i] == g and docs[i][0] is not None), default=None) for g in set(root)}
    assert Counter(tuple(r) for r in rows) == Counter((docs[i][0], f"{want_print[i]:016x}", label[root[i]]) for i in range(len(docs)))
    assert simhash.op3(empty(spark)).count() == 0


def test_keep_first(spark):
    ship(spark)
    docs = hostile(spark, EXTRA)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    all_docs = texts(EXTRA)
    root = groups(len(all_docs), close_pairs([simhash.fingerprint(t) for _, t in all_docs]))
    want = Counter(min((all_docs[i][0] for i in range(len(all_docs)) if root[i] == g and all_docs[i][0] is not None), default=None)
                   for g in set(root))
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert simhash.keep_first(empty(spark)).count() == 0
