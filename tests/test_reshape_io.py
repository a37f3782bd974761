"""Reshape verbs, sets, sinks and streaming."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from sheaf import Wrangler, re_, read_lines, read_text
from sheaf.sources.text import output_name
from sheaf.streaming.live import stream_text, to_memory


def rows(w):
    return [tuple(r) for r in w.ordered_df(with_part=False).collect()]


@pytest.fixture
def small(spark):
    df = spark.createDataFrame([(0, "a", "b", "c", "d"), (1, "e", "f", "g", "h"),
                                (2, "i", "j", "k", "l")], "k long, w string, x string, y string, z string")
    return Wrangler(df, order_by="k").drop("k")


def test_wrap_cells_and_rows(small):
    assert rows(small.wrap(2)) == [("a", "c"), ("b", "d"), ("e", "g"), ("f", "h"), ("i", "k"),
                                   ("j", "l")]
    assert rows(small.wrap(3)) == [("a", "d"), ("b", ""), ("c", ""), ("e", "h"), ("f", ""),
                                   ("g", ""), ("i", "l"), ("j", ""), ("k", "")]
    two = small.drop(["y", "z"]).wrap_rows(2)
    assert two.columns == ["c0", "c1", "c2", "c3"]
    assert rows(two) == [("a", "b", "e", "f"), ("i", "j", "", "")]
    with pytest.raises(ValueError):
        small.wrap_rows(400)


def test_fold_unfold_roundtrip(small):
    f = small.fold(["x", "y"])
    assert f.columns == ["w", "z", "key", "value"]
    assert rows(f)[:2] == [("a", "d", "x", "b"), ("a", "d", "y", "c")]
    u = f.unfold("key", "value")
    assert sorted(rows(u)) == [("a", "d", "b", "c"), ("e", "h", "f", "g"), ("i", "l", "j", "k")]
    kr = small.fold(["x", "y"], rows=[0])
    assert kr.columns == ["w", "z", "key", "value"]
    assert rows(kr) == [("e", "h", "b", "f"), ("e", "h", "c", "g"), ("i", "l", "b", "j"),
                        ("i", "l", "c", "k")]


def test_transpose_and_translate(small):
    t = small.transpose()
    assert rows(t) == [("a", "e", "i"), ("b", "f", "j"), ("c", "g", "k"), ("d", "h", "l")]
    assert rows(t.transpose()) == rows(small)
    assert rows(small.translate_down(1))[0] == ("", "", "", "")
    assert rows(small.translate_up(1))[-1] == ("", "", "", "")
    assert small.translate_right(2).columns == ["w", "x", "y", "z", "blank0", "blank1"]
    up = small.translate(direction="up", distance=1)
    assert rows(up) == [("e", "f", "g", "h"), ("i", "j", "k", "l"), ("", "", "", "")]
    col_up = small.translate("x", "up", 1)
    assert rows(col_up) == [("a", "f", "c", "d"), ("e", "j", "g", "h"), ("i", "", "k", "l")]
    with pytest.raises(ValueError):
        small.transpose(max_rows=2)


def test_union_and_parts(spark, small):
    other = Wrangler(spark.createDataFrame([(9, "p", "q")], "k long, u string, v string"),
                     order_by="k").drop("k")
    u = small.union(other)
    assert u.columns == ["w", "x", "y", "z"]
    assert rows(u)[-1] == ("p", "q", "", "")
    p = small.partition(lambda c: c.isin("a", "e").cast("string"), "w")
    assert p.has_part
    assert sorted(r[0] for r in p.merge_parts(["true"]).to_df().collect()) == ["a", "e"]
    # ordered verbs run per partition
    rid = p.with_row_id().to_df().collect()
    assert sorted((r["_part"], r["row_id"]) for r in rid) == [("false", 0), ("true", 0),
                                                             ("true", 1)]
    d = p.demote(0)
    assert sorted(r[0] for r in d.to_df().collect()) == ["a", "e", "i", "w", "w"]


def test_write_text_roundtrip(spark, tmp_path, small):
    out = str(tmp_path / "out")
    small.write_text(out)
    lines = [x for f in sorted(glob.glob(out + "/part-*")) for x in open(f).read().splitlines()]
    assert lines == ["w,x,y,z", "a,b,c,d", "e,f,g,h", "i,j,k,l"]  # one header for the table
    back = read_text(spark, out, cols=",").promote(row=0)
    assert back.columns == ["w", "x", "y", "z"] and rows(back) == rows(small)
    parted = str(tmp_path / "parted")
    small.partition(column="w").write_text(parted)
    assert sorted(d for d in os.listdir(parted) if d.startswith("_part=")) == [
        "_part=a", "_part=e", "_part=i"]
    assert output_name("x.csv") == "x.rdd" and output_name("x.rdd") == "x.rdd.rdd"
    assert output_name("x") == "x.rdd"
    assert small.force() == 3
    assert small.preview(2).splitlines() == ["w,x,y,z", "a,b,c,d", "e,f,g,h"]


def test_line_separator(spark, textfile):
    w = read_lines(spark, textfile("a;b;c;"), rows=";")
    assert [r[0] for r in w.ordered_df().collect()] == ["a", "b", "c"]


def test_streaming_row_local_verbs(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("1,x-y\n2,p-q\n")
    (src / "b.txt").write_text("3,m-n\n")
    w = stream_text(spark, str(src), cols=",", width=2)
    assert w.is_streaming
    w = w.cut_all("-", "c1").split_index(0, "c1").delete(pred=lambda c: c == "2", columns="c0")
    q = to_memory(w, "sheaf_stream_test", str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM sheaf_stream_test").collect())
    assert got == [("1", "", "y"), ("3", "", "n")]
    with pytest.raises(ValueError):
        stream_text(spark, str(src), cols=",")


def test_streaming_file_sink_partitioned(spark, tmp_path):
    from sheaf.streaming.live import write_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("k1,a b\nk2,c d\nk1,e f\n")
    w = stream_text(spark, str(src), cols=",", width=2).split_value(" ", "c1").partition(column="c0")
    q = write_stream(w, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = sorted(tuple(r) for r in out.select("_part", "c1_1", "c1_2").collect())
    assert got == [("k1", "a", "b"), ("k1", "e", "f"), ("k2", "c", "d")]


def test_wrap_where_as_array(spark):
    df = spark.createDataFrame([(0, "1", "2"), (1, "2", "4"), (2, "3", "5")],
                               "k long, a string, b string")
    w = Wrangler(df, order_by="k").drop("k").wrap(where="2", as_array=True)
    assert w.columns == ["cells"]
    assert [r[0] for r in w.ordered_df().collect()] == [["1"], ["2", "3"], ["2", "4", "5"]]


def test_write_text_keeps_row_order(spark, tmp_path):
    df = spark.range(200).select((199 - F.col("id")).alias("k"), F.col("id").cast("string").alias("v"))
    w = Wrangler(df.repartition(7), order_by="k").drop("k")
    out = str(tmp_path / "ordered")
    w.write_text(out)
    lines = []
    for f in sorted(glob.glob(out + "/part-*")):
        content = open(f).read().splitlines()
        lines += content
    assert lines == ["v", *[str(i) for i in range(199, -1, -1)]]


def test_unordered_union_unfold_and_partitioned_translate(spark):
    a = Wrangler(spark.createDataFrame([("k1", "t", "1"), ("k1", "u", "2"), ("k2", "t", "3")],
                                       "g string, key string, v string"))
    assert sorted(tuple(r) for r in a.unfold("key", "v").to_df().collect()) == [
        ("k1", "1", "2"), ("k2", "3", "")]
    u = a.union(Wrangler(spark.createDataFrame([("z",)], "q string")))
    assert sorted(tuple(r) for r in u.to_df().collect()) == [
        ("k1", "t", "1"), ("k1", "u", "2"), ("k2", "t", "3"), ("z", "", "")]
    df = spark.createDataFrame([(i, "p" if i < 3 else "q", f"v{i}") for i in range(5)],
                               "k long, g string, v string")
    w = Wrangler(df, order_by="k", part="g").drop(["k", "g"])
    down = w.translate("v", "down", 1).to_df().collect()
    assert sorted((r["_part"], r["v"]) for r in down) == [
        ("p", ""), ("p", "v0"), ("p", "v1"), ("p", "v2"), ("q", ""), ("q", "v3"), ("q", "v4")]
    rows_ = w.translate_down(1).to_df().collect()
    assert sorted((r["_part"], r["v"]) for r in rows_) == [
        ("p", ""), ("p", "v0"), ("p", "v1"), ("p", "v2"), ("q", ""), ("q", "v3"), ("q", "v4")]


def test_read_table_leaves_the_scan_alone(spark):
    from sheaf.sources.tables import read_table

    df = read_table(spark, "/root/testdata/sf0.01/part.parquet", ["p_partkey", "p_name"])
    assert df.columns == ["p_partkey", "p_name"]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_text_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, ""), (2, "b"), (3, "")], "k int, v string")
    w = Wrangler(df, order_by="k").drop("k")
    w.write_text(str(tmp_path / "one"))
    back = read_text(spark, str(tmp_path / "one")).promote(row=0)
    assert back.columns == ["v"] and rows(back) == [("a",), ("",), ("b",), ("",)]
    w.write_text(str(tmp_path / "bare"), header=False)
    assert rows(read_text(spark, str(tmp_path / "bare"))) == [("a",), ("",), ("b",), ("",)]
    many = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v"))
    for i, w in enumerate((Wrangler(many.repartition(4)), Wrangler(many.repartition(4), order_by=F.col("k").cast("int")))):
        w.write_text(str(tmp_path / f"many{i}"))
        back = read_text(spark, str(tmp_path / f"many{i}"), cols=",").promote(row=0)
        assert back.columns == ["k", "v"]
        got = [r[0] for r in rows(back)]
        assert sorted(got, key=int) == [str(k) for k in range(100)] and (i == 0 or got == [str(k) for k in range(100)])
    p = Wrangler(many.withColumn("g", F.col("k").cast("int") % 3), order_by=F.col("k").cast("int"), part="g").drop("g")
    p.write_text(str(tmp_path / "parts"))
    back = read_text(spark, str(tmp_path / "parts" / "_part=1"), cols=",").promote(row=0)
    assert [r[0] for r in rows(back)] == [str(k) for k in range(1, 100, 3)]


def test_promoted_row_does_not_depend_on_splits(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,v\n" + "".join(f"{i},x{i}\n" for i in range(1500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        w = read_text(spark, str(path), cols=",").promote(row=0)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        assert w.columns == ["k", "v"] and w.to_df().count() == 1500
        assert w.to_df().where("k = 'k'").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


HARD = ["a.b", "Name", "name", "__id", "_part", "x`y", "sp ace", "é", "x0ff", "key", "dup.1", ""]


def test_any_header_is_a_column_name(spark):
    names = [n or "c11" for n in HARD]
    df = spark.createDataFrame([(0, *[f"v {i}" for i in range(12)]), (1, *[""] * 12), (2, *[f"w {i}" for i in range(12)])],
                               "k int, " + ", ".join(f"c{i} string" for i in range(12)))
    w = Wrangler(df, order_by="k").drop("k").promote(names=HARD[:11])
    assert w.columns == names and w.to_df().columns == names
    assert w.cut_all(" ", "a.b").to_df().collect()[0][0] == "v0"
    assert rows(w.fill_down("Name"))[1][1] == "v 1" and rows(w.fill_up("name"))[1][2] == "w 2"
    assert w.split_value(" ", "__id").columns[3:5] == ["__id_1", "__id_2"]
    assert w.merge(["Name", "name"], glue="+").columns[1] == "Namename"
    assert w.drop("a.b").columns == names[1:] and w.rename({"x`y": "a,b"}).columns[5] == "a,b"
    assert w.rename({"Name": "name", "name": "Name"}).columns[1:3] == ["name", "Name"]
    assert w["_part"].cut_all("v").columns == names and w["sp ace"].rename("SP.ACE").columns[6] == "SP.ACE"
    d = w.demote(0)
    assert rows(d)[0] == tuple(names) and d.promote(row=0).columns == names
    folded = w.delete(rows=[1, 2]).fold(["a.b", "Name", "name"], key="column", value="cell")
    assert sorted(r["column"] for r in folded.to_df().collect()) == ["Name", "a.b", "name"]
    assert w.translate_left(1).columns[1:] == names and w.wrap_cells(2).columns[0] == "c0"
    assert w.union(w).columns == names and w.partition(lambda c: c, "a.b").has_part
    assert w.fill_left(["Name", "name"]).columns == names and w.extract_index(0, "é").columns[7:9] == ["é_1", "é_2"]
    again = Wrangler(w.to_df(), order_by="__id", part="a.b")
    assert again.columns == names and again.with_row_id().to_df().count() == 3


def test_fold_and_unfold_take_any_value(spark):
    df = spark.createDataFrame([(0, "r", "x.y", "1"), (1, "r", None, "2"), (2, "s", "Name", "3"), (3, "s", "name", "4"),
                                (4, "s", "name", "5")], "k int, id string, key string, m string")
    w = Wrangler(df, order_by="k").drop("k").unfold("key", "m")
    assert w.columns == ["id", "null", "Name", "name", "x.y"]
    assert rows(w) == [("r", "2", "", "", "1"), ("s", "", "3", "4", "")]
    two = Wrangler(df, order_by="k").drop("k").unfold(["id", "key"], "m")
    assert two.columns == ["r_null", "r_x.y", "s_Name", "s_name"] and rows(two) == [("2", "1", "3", "4")]
    back = w.fold(["null", "Name", "name", "x.y"])
    assert {tuple(r) for r in rows(back)} >= {("r", "x.y", "1"), ("s", "Name", "3"), ("r", "null", "2")}


def test_fold_key_rows_per_partition(spark):
    df = spark.createDataFrame([(0, "p", "h1", "i1"), (1, "p", "a", "b"), (2, "q", "h2", "i2"), (3, "q", "c", "d"), (4, "q", "e", "f")],
                               "k int, g string, x string, y string")
    w = Wrangler(df, order_by="k", part="g").drop(["k", "g"]).fold(["x", "y"], rows=[0])
    got = {(r["_part"], r["key"], r["value"]) for r in w.to_df().collect()}
    assert got == {("p", "h1", "a"), ("p", "i1", "b"), ("q", "h2", "c"), ("q", "i2", "d"), ("q", "h2", "e"), ("q", "i2", "f")}
    free = Wrangler(df.select("x", "y")).fold(["x", "y"], where=lambda c: c == "h1").to_df().collect()
    assert len(free) == 8 and {r["key"] for r in free} == {"h1", "i1"}


def test_wrap_column_by_predicate_and_handle(spark):
    df = spark.createDataFrame([(0, "1", "2"), (1, "2", "4"), (2, "3", "5")], "k int, a string, b string")
    w = Wrangler(df, order_by="k").drop("k")
    assert rows(w.wrap_column(lambda c: c == "2")) == rows(w.wrap_column("2"))
    assert rows(w["a"].translate("down", 1)) == rows(w.translate("a", "down", 1))
    assert rows(w["b"].fill_column("a", blank="4")) == rows(w.fill_column("a", "b", blank="4"))
    assert w["a"].unfold("b").columns == ["1", "2", "3"] and w["a"].drop().columns == ["b"]


def test_force_runs_every_cell(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("s"))
    assert Wrangler(df).force() == 10
    with pytest.raises(Exception, match="forced"):
        Wrangler(df).edit(fn=lambda c: F.when(c == "7", F.raise_error(F.lit("forced"))).otherwise(c)).force()


def test_wrap_column_n_form(small):
    assert rows(small.wrap_column(2, columns=["w", "y"])) == [("a", "c", "e", "g"), ("i", "k", "", "")]


# -- S2: rows separated by a regex ------------------------------------------------

def _split_rows(text, pattern):
    import re
    if text and not text.endswith("\n"):
        text += "\n"
    rows = re.split(pattern, text)
    if rows[-1].endswith("\n"):
        rows[-1] = rows[-1][:-1]
    return rows[:-1] if rows[-1] == "" else rows


@pytest.mark.parametrize("pattern", [r"\r?\n|;", "[;|]", r";\n?", r"\n", r"(?:;;|\|)", r";|\r\n"])
def test_regex_row_separators_over_many_splits(spark, tmp_path, pattern):
    import random
    rng = random.Random(len(pattern))
    texts = ["", "a", "a;b\n", "a;b;", ";;\n\n;", "x\r\ny;\nz|q", "a;b;\n", "one\ntwo\n\n"]
    texts += ["".join(rng.choice(["ab", ";", "\n", "\r\n", "|", "é", "long text ", ";\n"]) for _ in range(400)) for _ in range(3)]
    for i, t in enumerate(texts):
        (tmp_path / f"f{i:02d}.txt").write_bytes(t.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        w = read_text(spark, str(tmp_path), rows=re_(pattern))
        got = [r[0] for r in w.ordered_df().collect()]
        ids = sorted((r["row_id"], r["value"]) for r in w.with_row_id().to_df().collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [r for t in texts for r in _split_rows(t, pattern)]
    assert got == want
    assert [v for _, v in ids] == want and [i for i, _ in ids] == list(range(len(want)))


def test_regex_row_separator_splits_columns(spark, textfile):
    w = read_text(spark, textfile("1,2;3,4\n5,6\r\n"), rows=re_(r"\r?\n|;"), cols=",")
    assert [tuple(r) for r in rows(w)] == [("1", "2"), ("3", "4"), ("5", "6")]


@pytest.mark.parametrize("pattern", ["\n+", "\n;", "a*", r"\s\s", "(?=;)", "^;", "(", r"(\n|;)x", r"[^a]+"])
def test_regex_row_separators_that_cannot_be_read_by_lines(spark, textfile, pattern):
    with pytest.raises(ValueError):
        read_text(spark, textfile("a\n"), rows=re_(pattern))


def test_long_table_is_transposed_in_tiles(spark, tmp_path):
    n = 50000
    df = spark.range(n).select(*[F.concat(F.lit(x), ((F.col("id") * 7919) % n).cast("string")).alias(x) for x in "abcd"],
                               F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("e"), "id")
    w = Wrangler(df.repartition(7), order_by="id").drop("id")
    w.write_transposed(str(tmp_path / "t"), sep=",", block_rows=777)
    want = {i: [f"{x}{j * 7919 % n}" for j in range(n)] for i, x in enumerate("abcd")}
    want[4] = [str(j) if j % 5 else "" for j in range(n)]
    for i in range(5):
        parts = sorted(glob.glob(str(tmp_path / "t" / f"row={i}" / "part-*")))
        assert "".join(open(p).read() for p in parts) == ",".join(want[i]) + ","
    small = Wrangler(spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, s string"), order_by="k")
    assert [tuple(r) for r in small.transpose_tiles(2).ordered_df().collect()] == [
        (0, 0, ["1", "2"]), (0, 1, ["3"]), (1, 0, ["x", "y"]), (1, 1, [None])]


def test_headers_of_many_partition_keys(spark, tmp_path):
    df = spark.range(600).select((F.col("id") % 40).alias("g"), F.col("id").cast("string").alias("v"))
    w = Wrangler(df, order_by="v", part="g").drop("g")
    w.write_text(str(tmp_path / "t"))
    for g in range(40):
        parts = sorted(glob.glob(str(tmp_path / "t" / f"_part={g}" / "part-*")))
        lines = "".join(open(p).read() for p in parts).splitlines()
        assert lines == ["v", *sorted(str(i) for i in range(600) if i % 40 == g)]
