"""op2: base spans against plain regular expressions, what is learned, redaction."""
import hashlib
import re
from collections import Counter

import numpy as np
from hostile import empty, hostile, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import pii
from sheaf.llm.common import ship

EXTRA = [(300 + i, f"some words here, call (275) 555-59{i:02d} today") for i in range(30)]
EXTRA += [(400 + i, f"reach me by phone at +1 (275) 555-59{i:02d} or by email ann{i}@shop.example.com now") for i in range(30)]
EXTRA += [(500 + i, f'token = "{i:02d}07915762804490{i:02d}77" and build {i}.300.400.500') for i in range(30)]


def plain(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "a", "-", "1", "25", "256", "1.2.3.4", "+", "+1 ", "4111111111111111", " ", "(", "é", "@x.y", "%", "00"]),
                max_size=20).map("".join))
def test_base_spans(text):
    assert sorted((s, k, e) for s, e, k in pii.matches(text)[0]) == plain(text)


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000 + "@b", "1" * 200_000, "1." * 100_000, "+1(" * 50_000, "a@" * 100_000, "1 " * 100_000):
        pii.matches(t)


def test_query(spark):
    ship(spark)
    rows = pii.op2(hostile(spark, EXTRA)).collect()
    want = Counter()
    for i, t in texts(EXTRA):
        s = plain(t) if len(t) < 50000 else []
        n = Counter(k for _, k, _ in s)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s)
        want[(i, n[0], n[1], n[2], n[3], hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    for r in rows:  # base spans stay among all spans
        assert hashlib.sha256(",".join(s for s in r.spans.split(",") if s in {
            f"{pii.KINDS[k]}:{a}:{b}" for i, t in texts(EXTRA) if i == r.doc_id and len(t) < 50000 for a, k, b in plain(t)}).encode()).hexdigest() == r.base_sha256
        if r.doc_id is not None and 500 <= r.doc_id < 530:
            assert r.n_added == 0  # digits of a token and a build number are no personal data
    assert pii.op2(empty(spark)).count() == 0


def test_learned_classifier_takes_national_numbers(spark):
    ship(spark)
    fit = pii.fit(pii.candidates(hostile(spark, EXTRA)))
    assert "[PHONE]" in pii.redact_text(EXTRA[3][1], fit["accepted"])
    assert pii.redact_text(EXTRA[70][1], fit["accepted"]) == EXTRA[70][1]
    good, bad = fit["reliability"][1], fit["reliability"][0]
    assert good[0, 2] > bad[0, 2] and good[1, 2] > bad[1, 2]  # format and checksum say yes more often when it is true


def test_expectation_maximisation_finds_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.4
    right = np.array([0.95, 0.85, 0.6, 0.7, 0.9])
    votes = np.where(rng.random((20000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, table = pii.expectation_maximisation(patterns, np.zeros(len(n), int), n.astype(float))
    assert (((p > 0.5)[back.ravel()]) == truth).mean() > 0.97
    assert np.abs(table[1, :, 2] - right).max() < 0.03


def test_codes_round_trip():
    for v in [(1, -1, 0, 1, -1), (0, 0, 0, 0, 0), (-1, 1, 1, -1, 1)]:
        for f in [(0, 0, 0), (7, 2, 1)]:
            for k in range(4):
                kind, votes, feats = pii.decode_codes(np.array([pii.code(v, f, k)]))
                assert (kind[0], tuple(votes[0]), tuple(feats[0])) == (k, v, f)


def test_redact(spark):
    ship(spark)
    docs = hostile(spark, EXTRA)
    out = pii.redact(docs, frozenset())
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[11] == "mail [EMAIL] or [IP], card [CARD], call [PHONE] now"
    assert got[4] is None and got[3] == "" and got[1] == texts()[0][1]
    assert pii.redact(empty(spark), frozenset()).count() == 0


def test_candidates_give_way_in_one_pass():
    import time
    text = "999.1.1.1 10.0.0.1 x " * 20000
    t = time.time()
    base, more = pii.matches(text)
    assert time.time() - t < 5 and len(base) == 20000 and len(more) == 20000
    spans = sorted((a, b) for a, b, _ in [*base, *more])
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_the_classifier_acts_alike_at_every_size():
    import numpy as np
    rng = np.random.default_rng(3)
    x, p, n = rng.random((20, 4)), rng.random(20), rng.integers(1, 50, 20)
    assert np.allclose(pii.train_classifier(x, p, n), pii.train_classifier(x, p, n * 100_000), atol=1e-6)
