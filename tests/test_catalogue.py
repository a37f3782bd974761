"""The driver contract: entry() smoke, and every catalogued query against its
DuckDB oracle on the smallest tables."""

import importlib.util
import os

import pytest

from sheaf.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def _load(name, path):
    spec = importlib.util.spec_from_file_location(name, path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


E = _load("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
CHECK = _load("check_oracle", os.path.join(ROOT, "scripts", "check_oracle.py"))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["_part", "n"]
    assert df.count() > 0


def test_every_verb_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracles())
    assert set(catalogue.queries()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return CHECK.duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_oracle(spark, con, name):
    ok, msg, _ = CHECK.compare(catalogue.queries()[name](spark, SF), con, catalogue.oracles()[name])
    assert ok, msg


def test_headers_that_differ_by_case_are_written_and_read(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [("F", 1), ("F", 3), ("O", 2), ("O", 7)]
    pq.write_table(pa.table({"l_linestatus": [s for s, _ in rows], "l_linenumber": [n for _, n in rows]}), tmp_path / "lineitem.parquet")
    out, was = str(tmp_path / "out"), spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "false")
    try:
        catalogue.queries()["unfold_any_value"](spark, str(tmp_path)).write.parquet(out)
        back = spark.read.parquet(out).select("l_linestatus", "`a.1`", "`a.2`", "null", "`A.1`")
        assert sorted(tuple(r) for r in back.collect()) == [("F", "1", "", "", "1"), ("O", "", "1", "1", "")]
    finally:
        spark.conf.set("spark.sql.caseSensitive", was)


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "print(len(E.queries()), len(E.oracle_sql()))" % ROOT)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_bench_prints_one_json_line():
    import json
    import subprocess
    import sys

    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_QUERIES="cut_index,row_id", BENCH_REPEATS="1",
               BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], capture_output=True,
                         text=True, timeout=600, env=env)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [l for l in out.stdout.splitlines() if l.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert set(d["queries"]) == {"cut_index", "row_id"} and d["unit"] == "sec"
