"""op7: against a plain version, policies and ablations."""
import re
from collections import Counter

import pytest
from hostile import empty, hostile, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import quality
from sheaf.llm.common import ship


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    top = max(Counter(words).values(), default=0)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(cover), top)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#|\x1cé ", max_size=80))
def test_measures(text):
    assert quality.measure(text) == plain(text)


def test_many_distinct_words_rank_exactly():
    text = " ".join(f"w{i}" for i in range(9000)) + " " + " ".join(f"w{i}" for i in range(100, 107))
    assert quality.measure(text)[5] == plain(text)[5] == 14


def test_rows(spark):
    ship(spark)
    extra = [(50, "spam " * 30), (51, "a | b | c | d | e | f | g | h | i | j | k"), (52, "\n".join(["dull line"] * 9 + [f"l {i}" for i in range(9)]))]
    rows = quality.op7(hostile(spark, extra)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.top_word) for r in rows) == \
        Counter((i, *plain(t)) for i, t in texts(extra))
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in rows}
    assert by[1].kept and not by[50].kept and not by[51].kept and not by[52].kept and not by[4].kept


def test_policy_keeps_rows_and_columns(spark):
    ship(spark)
    docs = hostile(spark)
    out = quality.apply_policy(docs, quality.POLICIES["full-1"])
    assert out.columns == docs.columns
    kept = Counter(r.doc_id for r in quality.op7(docs).where("kept").collect())
    assert Counter(r.doc_id for r in out.collect()) == kept
    assert quality.apply_policy(empty(spark), ["few_words"]).count() == 0 and quality.op7(empty(spark)).count() == 0


@pytest.mark.parametrize("policy", quality.POLICIES.values())
def test_ablations(spark, policy):
    ship(spark)
    led = quality.ledger(hostile(spark))
    bits, names = [r.failure_bits for r in led.collect()], [n for n, _ in quality.RULES]
    m = quality.mask(policy)
    got = {r.rule: (r.failing, r.failing_only, r.kept) for r in quality.ablations(led, policy).collect()}
    for rule in policy:
        bit = 1 << names.index(rule)
        assert got[rule] == (sum(b & m & bit > 0 for b in bits), sum(b & m == bit for b in bits), sum(b & m == 0 for b in bits))
