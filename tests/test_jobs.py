"""The sample jobs on their native input shapes, against plain-Python models."""

import random

from sheaf import read_lines, read_text
from sheaf.plans import jobs

ADAPTER = "AGAT"


def clip_match(seq):
    return len(seq) >= 4 and all(c == a or c == "N" for c, a in zip(seq[:4], ADAPTER))


def fastq_reads(n=300, seed=7):
    rnd = random.Random(seed)
    reads = []
    for i in range(n):
        head = rnd.choice(["AGAT", "NGAT", "ANNT", "TTTT", "AGCT", "AG", ""])
        seq = head + "".join(rnd.choice("ACGTN") for _ in range(rnd.randint(0, 20)))
        reads.append((f"@r{i}", seq, "+", "I" * len(seq)))
    return reads


def test_read_clipping_from_raw_fastq(spark, textfile):
    reads = fastq_reads()
    path = textfile("".join(f"{a}\n{b}\n{c}\n{d}\n" for a, b, c, d in reads), "in.fastq")
    w = read_lines(spark, path).wrap_rows(4).promote(names=["def", "seq", "line3", "line4"])
    out = jobs.clip_reads(w, "seq")
    got = sorted((r["def"], r["seq"]) for r in out.to_df().collect())
    exp = sorted((d, s[13:] if len(s) > 13 else s) for d, s, _, _ in reads if not clip_match(s))
    assert got == exp
    assert out.force() == len(exp)


def test_barcode_counts_from_tab_separated_reads(spark, textfile):
    reads = fastq_reads(400, seed=3)
    path = textfile("".join("\t".join(r) + "\n" for r in reads), "reads.tsv")
    w = read_text(spark, path, cols="\t", names=["def", "seq", "line3", "line4"])
    got = {r["_part"]: r["n"] for r in jobs.barcode_counts(w, "seq").collect()}
    exp = {}
    for _, s, _, _ in reads:
        if not clip_match(s):
            exp[s[4:8]] = exp.get(s[4:8], 0) + 1
    assert got == exp


def test_incremental_force(spark, textfile):
    path = textfile("112,34\n3,14\n", "hel.csv")
    first, counts = jobs.incremental_force(read_text(spark, path, cols=","))
    assert counts == [2, 2, 2]
    assert sorted(tuple(r) for r in first.to_df().collect()) == [("12", "34"), ("3", "4")]
