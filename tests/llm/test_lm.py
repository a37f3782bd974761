"""op6: against a plain Kneser-Ney model, and that probabilities sum to one."""
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hostile import empty, hostile, texts

from sheaf.llm import kneser_ney as kn
from sheaf.llm.common import ship

EXTRA = [(600 + i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(40))) for i in range(60)]


def split(t):
    lower = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class Plain:
    def __init__(self, docs):
        self.c, self.pairs, self.n_texts = Counter(), Counter(), len(docs)
        for t in docs:
            w = split(t)
            self.c.update(w)
            self.pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
        self.follow = defaultdict(list)
        for (a, _), n in self.pairs.items():
            self.follow[a].append(n)
        self.cont = Counter(w for _, w in self.pairs)
        self.dw, self.dp = self.disc(self.cont), self.disc(self.pairs)

    @staticmethod
    def disc(counts):
        return kn.discounts([sum(1 for x in counts.values() if x == k) for k in (1, 2, 3, 4)])

    def q(self, w):
        types, v = len(self.pairs), len(self.c)
        if not types:
            return 1 / (v + 1)
        left = sum(self.dw[min(x, 3)] for x in self.cont.values()) / types
        return max(self.cont[w] - self.dw[min(self.cont[w], 3)], 0) / types + left / (v + 1)

    def p(self, a, w):
        total = self.n_texts if a == "<s>" else self.c[a]
        if a not in self.follow or not total:
            return self.q(w)
        n = self.pairs[(a, w)]
        return max(n - self.dp[min(n, 3)], 0) / total + sum(self.dp[min(x, 3)] for x in self.follow[a]) / total * self.q(w)


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_scores(spark, shards):
    ship(spark)
    docs = hostile(spark, EXTRA)
    training = docs.where(~kn.held_out("doc_id"))
    rows = kn.score(docs, kn.train(training, shards=shards)).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts(EXTRA)]
    m = Plain([t for (_, t), h in zip(texts(EXTRA), held, strict=True) if not h])
    n, v = sum(m.c.values()), len(m.c)
    want = []
    for (i, t), h in zip(texts(EXTRA), held, strict=True):
        w = split(t)
        base = sum(math.log10((m.c[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(m.p(a, x)) for a, x in zip(["<s>", *w[:-1]], w, strict=True))
        want.append((i if i is not None else -1, h, len(w), sum(m.c[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    got = [(r.id if r.id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows]
    assert sorted(got) == sorted(want)
    assert 10 ** (-sum(x[6] for x in want if x[0] >= 600) / sum(x[2] for x in want if x[0] >= 600)) < 30


def test_probabilities_sum_to_one():
    m = Plain([t for _, t in EXTRA])
    for a in ("<s>", "w3", "w5", "never seen"):
        assert abs(sum(m.p(a, w) for w in [*m.c, "unknown"]) - 1) < 1e-9


def test_nothing_to_train_on(spark):
    ship(spark)
    assert kn.op6(empty(spark)).count() == 0
    rows = kn.score(hostile(spark), kn.train(empty(spark))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 and r.base_score == 0 for r in rows)


def test_counter_merges(monkeypatch):
    monkeypatch.setattr(kn, "BLOCK", 10)
    c, rng = kn.Counter(), np.random.default_rng(0)
    blocks = [rng.integers(0, 50, 30).astype(np.uint64) for _ in range(20)]
    for b in blocks:
        c.add(b)
    k, n = c.merge()
    assert dict(zip(k.tolist(), n.tolist(), strict=True)) == Counter(np.concatenate(blocks).tolist())


def test_frequent_pairs_pass_a_byte():
    k, c = np.arange(600, dtype=np.uint64), np.arange(600)
    import pyarrow as pa
    t = pa.Table.from_batches(list(kn._dealt(k, c, np.zeros(600, np.int64))))
    k2, c2 = kn._blobs(t)
    assert (k2 == k).all() and (c2 == c).all()


def test_query_columns(spark):
    ship(spark)
    assert kn.op6(hostile(spark)).dtypes == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"),
        ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]


class Plain3(Plain):
    """Order 3: pairs count the different words before them, but for those that begin a text."""

    def __init__(self, docs):
        super().__init__(docs)
        self.raw, self.triples = self.pairs, Counter()
        for t in docs:
            w = ["<s>", *split(t)]
            self.triples.update(zip(w, w[1:], w[2:]))
        self.pairs = Counter((b, c) for _, b, c in self.triples)
        self.pairs.update({k: n for k, n in self.raw.items() if k[0] == "<s>"})
        assert set(self.pairs) == set(self.raw)
        self.follow, self.after, self.sums = defaultdict(list), defaultdict(list), Counter()
        for (a, _), n in self.pairs.items():
            self.follow[a].append(n)
            self.sums[a] += n
        for (a, b, _), n in self.triples.items():
            self.after[a, b].append(n)
        self.dp, self.dt = self.disc(self.pairs), self.disc(self.triples)

    def p2(self, b, w):
        if b not in self.follow:
            return self.q(w)
        n, total = self.pairs[b, w], self.sums[b]
        return max(n - self.dp[min(n, 3)], 0) / total + sum(self.dp[min(x, 3)] for x in self.follow[b]) / total * self.q(w)

    def p(self, a, b, w):
        if (a, b) not in self.after:
            return self.p2(b, w)
        n, total = self.triples[a, b, w], sum(self.after[a, b])
        return max(n - self.dt[min(n, 3)], 0) / total + sum(self.dt[min(x, 3)] for x in self.after[a, b]) / total * self.p2(b, w)


def log3(m, t):
    w = [None, "<s>", *split(t)]  # nothing comes before a text's start
    return sum(math.log10(m.p(*x)) for x in zip(w, w[1:], w[2:]))


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_scores_of_order_3(spark, shards):
    ship(spark)
    docs = hostile(spark, EXTRA)
    rows = kn.score(docs, kn.train(docs.where(~kn.held_out("doc_id")), shards=shards, order=3)).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts(EXTRA)]
    m = Plain3([t for (_, t), h in zip(texts(EXTRA), held, strict=True) if not h])
    want = sorted((i if i is not None else -1, round(log3(m, t), 6)) for i, t in texts(EXTRA))
    assert sorted((r.id if r.id is not None else -1, round(r.score, 6)) for r in rows) == want
    for a, b in (("w3", "w5"), ("<s>", "w0"), (None, "<s>"), ("the", "cat"), ("never", "seen")):
        assert abs(sum(m.p(a, b, w) for w in [*m.c, "unknown"]) - 1) < 1e-9


def test_the_query_sees_two_words_back(spark):
    """After "b" both "c" and "d" follow as often; only the word before tells which."""
    ship(spark)
    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "x b d") for i in range(100)]
                                 + [(1000, "a b c"), (1001, "a b d")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in kn.op6(docs).where("doc_id >= 1000").collect()}
    assert got[1000] > got[1001] + 0.5
    with pytest.raises(ValueError):
        kn.train(docs, order=4)


def test_packed_keys():
    rng = np.random.default_rng(0)
    for k in (rng.integers(0, 1 << 63, 1000, np.uint64), np.arange(5, dtype=np.uint64), np.array([2**64 - 1], np.uint64),
              (rng.integers(0, 9, 1000, np.uint64) << np.uint64(32)) | rng.integers(0, 1 << 32, 1000, np.uint64)):
        for keys in (k, np.sort(k)):
            assert (kn._unpacked(kn._packed(keys)) == keys).all()


def test_a_lost_file_is_an_error_not_an_empty_model(spark):
    import os
    model = kn.train(hostile(spark), order=3)
    assert kn.score(hostile(spark), model).count() > 0
    name = next(n for n, z in sorted(model["files"].items()) if z and n.startswith("word-") and n.endswith(".counts"))
    path = os.path.join(model["folder"], name)
    whole = open(path, "rb").read()
    for left in (whole[:-8], None):
        os.remove(path)
        if left is not None:
            with open(path, "wb") as f:
                f.write(left)
        with pytest.raises(Exception, match="language model"):
            kn.score(hostile(spark), model).collect()
        if left is None:
            break
    with pytest.raises(FileNotFoundError, match="word-0.keys"):
        kn.check_files({}, {"word-0.keys": 8})


def test_facts_of_words_take_few_bytes(spark):
    ship(spark)
    docs = hostile(spark, [(i, " ".join(f"v{i}x{k}" for k in range(200))) for i in range(20)])
    model = kn.train(docs, shards=4, order=3)
    facts = sum(z for n, z in model["files"].items() if n.startswith(("word-", "facts")) and not n.endswith(".keys"))
    assert model["vocabulary"] > 4000 and facts < 10 * model["vocabulary"]
