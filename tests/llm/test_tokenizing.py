"""op1, op8, op9: against the tokenizer on whole texts."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hostile import TEXTS, empty, hostile, texts
from pyspark.sql import functions as F

from sheaf.llm import bpe, packing, tokens
from sheaf.llm.common import byte_chunks, load_tokenizer, ship

rng = random.Random(5)
ALPHABET = ["the", "The", "cat", "cat,", "x.", ".,", "it's", "n't", "<|endoftext|>", "<|startoftext|>", "é.", "ß", "Σ", "42", " ",
            "é", "́", "!", "a.b,c", "😀", "don't.", "'S", "\x1c", "İ", "ﬁ,", " ", "A.́"]
RANDOM = [(100 + k, "".join(rng.choice(ALPHABET) + rng.choice(["", " ", "\n", "\t", "  "]) for _ in range(rng.randrange(60))))
          for k in range(60)]
COLLIDE = ("row zq18478", "row the cat 479361")  # one value of Spark's hash()


def ids(text):
    return load_tokenizer().encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return hostile(spark, RANDOM)


@pytest.mark.parametrize("hot", [0, 5, 300_000])
def test_encode_and_decode(spark, docs, hot):
    out = bpe.encode(docs, bpe.digests, "id {id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", hot=hot)
    got = Counter(tuple(r) for r in out.collect())
    want = Counter()
    for i, t in texts(RANDOM):
        x = ids(t)
        want[(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(),
              hashlib.sha256(load_tokenizer().decode(x, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want


def test_split_words(monkeypatch):
    import pyarrow as pa

    from sheaf.llm import words

    def plain(t):
        t = t or ""
        low = t if "<|" in t else t.translate({c: c + 32 for c in range(65, 91)})
        return [w for w in re.split(r"[ \t\n\x0B\f\r]+|(?<=[A-Za-z])(?=[.,])", low) if w]

    every = [t for _, t in [*TEXTS, *RANDOM]] + [None, "", " ", "a<", "|B", "Ab.,c <|X", "A.B,C", "é.x", "x\x0b.y"]
    for size in (1, 100, 8 << 20):
        monkeypatch.setattr(words, "SLICE", size)
        got = []
        for b in words.slices([pa.RecordBatch.from_pydict({"t": pa.array(every, pa.string())}).slice(k, 7) for k in range(0, len(every), 7)], 0):
            found, ends = words.split_words(b.column(0))
            got += [found.to_pylist()[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
        assert got == [plain(t) for t in every]


def test_ids_round_trip(spark, docs):
    table = bpe.encode(docs, bpe.ids_table, "id {id}, ids array<int>")
    got = Counter((r.id, tuple(r.ids)) for r in table.collect())
    assert got == Counter((i, tuple(ids(t))) for i, t in texts(RANDOM))
    back = Counter(tuple(r) for r in bpe.decode(table).collect())
    assert back == Counter((i, load_tokenizer().decode(ids(t), skip_special_tokens=False)) for i, t in texts(RANDOM))


@pytest.mark.parametrize("hot", [0, 7, 300_000])
def test_token_counts(docs, hot):
    got = Counter(tuple(r) for r in tokens.token_counts(docs, hot=hot).collect())
    assert got == Counter((i, len(t.encode()), len(ids(t))) for i, t in texts(RANDOM))


def test_texts_of_one_id_whose_hashes_collide(spark):
    """Equal 32-bit hashes under one id and under null ids."""
    ship(spark)
    rows = [(i, t) for i in (1, None) for t in (*COLLIDE, COLLIDE[0], "another", None)] + [(2, "unique")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert docs.where(F.col("text").isin(*COLLIDE)).select(F.hash("text")).distinct().count() == 1
    want = Counter((i, tuple(ids(t or ""))) for i, t in rows)
    for hot in (0, 5):
        got = Counter((r.id, tuple(r.ids)) for r in bpe.encode(docs, bpe.ids_table, "id {id}, ids array<int>", hot=hot).collect())
        assert got == want
        got = Counter(tuple(r) for r in tokens.token_counts(docs, hot=hot).collect())
        assert got == Counter((i, len((t or "").encode()), len(ids(t or ""))) for i, t in rows)


def test_empty_tables(spark):
    ship(spark)
    assert bpe.op1(empty(spark)).count() == 0
    assert tokens.op8(empty(spark)).count() == 0
    assert packing.op9(empty(spark)).count() == 0


def test_query_columns(docs):
    assert tokens.op8(docs).dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert bpe.op1(docs).dtypes[:3] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string")]


def test_byte_chunks_cut_at_white_space():
    data = b"aa bb\tcc\ndddddddddd ee" * 50
    for size in (1, 3, 10, 1000, 10_000):
        parts = list(byte_chunks(data, size))
        assert b"".join(parts) == data
        assert [w for p in parts for w in p.split()] == data.split()
    assert list(byte_chunks(b"")) == [b""]


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        assert 0 < r.length <= capacity
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_pieces_and_places(docs):
    rows = packing.op9(docs).collect()
    want = Counter()
    for i, t in texts(RANDOM):
        x = np.array([*ids(t), 1], "<u4")
        for k in range(0, len(x), 4096):
            want[(i, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(x[k : k + 4096].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n = check_packing(rows, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1


def test_pieces_of_a_text_in_chunks():
    word = np.arange(5, dtype="<u4").tobytes()
    got = list(packing.cut_pieces(iter([word] * 100), 64, 1))
    flat = np.frombuffer(word * 100 + (1).to_bytes(4, "little"), "<u4")
    want = [(k, 64 * k, len(flat[64 * k : 64 * k + 64]), zlib.crc32(flat[64 * k : 64 * k + 64].tobytes())) for k in range(-(-len(flat) // 64))]
    assert got == want
    exact = list(packing.cut_pieces(iter([np.arange(63, dtype="<u4").tobytes()]), 64, 1))
    assert [p[2] for p in exact] == [64]


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_best_fit_holds_every_capacity(rule):
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    seq, offset = packing.best_fit(lengths, 128, 3, 10000, rule)
    for s in np.unique(seq):
        own = lengths[seq == s]
        assert own.sum() <= 128 and len(own) <= 3 and (own**2).sum() <= 10000
        assert sorted(offset[seq == s]) == sorted(np.cumsum(np.concatenate([[0], own[np.argsort(offset[seq == s])]]))[:-1])
    plain, _ = packing.best_fit(lengths, 128, 128, 128 * 128)
    assert plain.max() + 1 <= 1.02 * lengths.sum() / 128 + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([200]), 128, 3, 10000)


def test_packing_in_small_groups(spark):
    ship(spark)
    p = spark.range(3000).select(F.col("id"), (F.col("id") % 97 + 1).alias("length"))
    rows = packing.pack(p, capacity=128, group_pieces=100).collect()
    assert len(rows) == 3000 and Counter(r.id for r in rows) == Counter(range(3000))
    check_packing(rows, 128)


def test_worker_cache_forgets(spark):
    w = packing.WordIds(keep=3)
    for t in ("a b c d e", "f g a", "a a b z y x w"):
        assert np.frombuffer(w(t.encode()), "<u4").tolist() == ids(t)
    assert len(TEXTS) > 10


def test_words_end_before_any_mark():
    import pyarrow as pa

    from sheaf.llm import words

    def plain(t):
        marks = r"[.,]" if "<|" in t else r"[!-/:-@\[-`{-~]"
        low = t if "<|" in t else t.translate({c: c + 32 for c in range(65, 91)})
        return [w for w in re.split(r"[ \t\n\x0B\f\r]+|(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=" + marks + ")", low) if w]

    every = [t for _, t in [*TEXTS, *RANDOM] if t is not None]
    every += ["cat*** cat&&& Cat###", "é?x", "×!", "a÷b'c", "é.x", "a_b", "é*<|endoftext|>é*,", "a<", "|B*", "ć.", "1.2", ""]
    found, ends = words.split_words(pa.array(every), fine=True)
    found = found.to_pylist()
    assert [found[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)] == [plain(t) for t in every]


def test_ids_by_words_are_those_of_the_text():
    """Contractions, marks, digits, accents and special strings in all orders, one text and many at once."""
    import pyarrow as pa

    some = ["'", "'s", "'re", "t", "re", "team", "S", "é", "É", "ß", "×", "÷", "ª", "\u0301", "\u0338", "<", "=", "|", "<|endoftext|>",
            "*", "_", ".", ",", "7", "\u00b2", "ć", "Σ", "İ", "ÿ", "中", " ", "\n", "\x85", "\xa0", "\x1c", "\x7f", "-"]
    r = random.Random(9)
    every = ["".join(r.choice(some) for _ in range(r.randrange(40))) for _ in range(3000)]
    got = packing.WordIds(keep=500).many(pa.array([*every, None, ""]))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids(t) for t in [*every, "", ""]]
    one = packing.WordIds(keep=50)
    for t in every[:300]:
        assert np.frombuffer(one(t.encode()), "<u4").tolist() == ids(t)


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.n = inner, 0

    def encode_batch_fast(self, some, **kw):
        self.n += len(some)
        return self.inner.encode_batch_fast(some, **kw)


def test_new_words_go_to_the_tokenizer_in_lines():
    r = random.Random(3)
    every = ["".join(r.choice("abcdeéßÑ") for _ in range(8)) for _ in range(5000)]
    text = " ".join(w + r.choice(["***", "&&&", "", "."]) for w in every)
    w = packing.WordIds()
    w.tokenizer = Counting(w.tokenizer)
    assert np.frombuffer(w(text.encode()), "<u4").tolist() == ids(text)
    assert w.tokenizer.n <= len(every) / packing.LINE + 5


def test_words_whose_ends_are_not_marked_go_one_by_one():
    w = packing.WordIds()
    w.last[:] = False
    text = "some words of letters, and é"
    assert np.frombuffer(w(text.encode()), "<u4").tolist() == ids(text)


def test_pieces_of_a_text_longer_than_is_looked_up_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "TOGETHER", 50)
    every = ["a b", None, "one two, three " * 40, "x" * 60, "", "last"]
    b = pa.RecordBatch.from_pydict({"id": pa.array(range(6)), "text": pa.array(every)})
    got = [tuple(r.values()) for o in packing._pieces(iter([b]), packing.WORD_BPE, 16, 1) for r in o.to_pylist()]
    want = []
    for i, t in enumerate(every):
        x = np.array([*ids(t or ""), 1], "<u4")
        want += [(i, k // 16, k, len(x[k : k + 16]), zlib.crc32(x[k : k + 16].tobytes())) for k in range(0, len(x), 16)]
    assert got == want
