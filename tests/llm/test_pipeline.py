"""The pipeline against a plain version of its stages, and the registration of all queries."""
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hostile import TEXTS, hostile
from test_pii import EXTRA as PERSONAL
from test_simhash import EXTRA as NEAR
from test_simhash import close_pairs, groups

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from sheaf.llm import pii, quality, simhash  # noqa: E402
from sheaf.llm.common import load_tokenizer, ship  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "best_fit_packing"]


def test_whole_run(spark, tmp_path):
    ship(spark)
    extra = [*NEAR, *PERSONAL, (3000, "spam " * 50), (3001, "short")]
    docs = hostile(spark, extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, t) for i, t in [*TEXTS, *extra]]
    policy = quality.mask(quality.POLICIES[quality.PRODUCTION])
    bits = {r.doc_id: r.failure_bits for r in quality.ledger(spark.createDataFrame(
        [(k, t) for k, (_, t) in enumerate(rows)], "doc_id int, text string")).collect()}
    kept = [(i, t) for k, (i, t) in enumerate(rows) if bits[k] & policy == 0]
    root = groups(len(kept), close_pairs([simhash.fingerprint(t) for _, t in kept]))
    first = {}
    for k, g in enumerate(root):
        if g not in first or (kept[k][0] is not None and (kept[first[g]][0] is None or kept[k][0] < kept[first[g]][0])):
            first[g] = k
    kept = [kept[k] for k in first.values()]
    accepted = pii.fit(pii.candidates(spark.createDataFrame(kept, "doc_id bigint, text string")))["accepted"]
    want = Counter()
    for i, t in kept:
        ids = load_tokenizer().encode(pii.redact_text(t, accepted) or "", add_special_tokens=False).ids
        x = np.array([*ids, 1], "<u4")
        for k in range(0, len(x), 4096):
            want[(i, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(x[k : k + 4096].tobytes()))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_stages_keep_columns_and_take_empty_tables(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).columns == docs.columns
        assert stage(spark, docs.where("doc_id < 0"), SF).count() == 0


@pytest.mark.parametrize("name", ["op7_quality_rules", "op10_chat_formatting"])
def test_sql(spark, name):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "scripts"))
    from check_oracle import compare, duck

    ok, message, n = compare(__spark_entry__.queries()[name](spark, SF), duck(SF), __spark_entry__.oracle_sql()[name])
    assert ok, message
    assert n > 0
