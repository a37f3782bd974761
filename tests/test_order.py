"""Ordered verbs (bucket + carry) vs a pandas model; several bucket counts,
key types and a skewed partition key (SURVEY §5 (d))."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf import Wrangler, read_text
from sheaf.plans import order as order_plan

SF = "/root/testdata/sf0.01"


@pytest.fixture(params=[1, 3, 300])
def buckets(request, spark):
    spark.conf.set("sheaf.order.buckets", str(request.param))
    yield request.param
    spark.conf.unset("sheaf.order.buckets")


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def test_row_id_numeric_key(spark, buckets):
    w = Wrangler(events(spark).select("event_id"), order_by="event_id").with_row_id()
    pdf = w.to_df().toPandas().sort_values("event_id")
    assert list(pdf["row_id"]) == list(range(len(pdf)))


def test_row_id_string_and_timestamp_keys(spark, buckets):
    cust = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_name")
    got = Wrangler(cust, order_by="c_name").with_row_id().to_df().toPandas()
    exp = got.sort_values("c_name", kind="stable").reset_index(drop=True)
    assert list(exp["row_id"]) == list(range(len(exp)))
    ev = events(spark).select("event_id", "ts")
    got = Wrangler(ev, order_by=["ts", "event_id"]).with_row_id().to_df().toPandas()
    exp = got.sort_values(["ts", "event_id"]).reset_index(drop=True)
    assert list(exp["row_id"]) == list(range(len(exp)))


def test_fill_up_down_with_skewed_parts(spark, buckets):
    # one partition key holds about a third of all rows
    ev = events(spark).select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(
            (F.col("user_id") % 7).cast("string")).alias("g"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")).alias("t"))
    w = Wrangler(ev, order_by="event_id", part="g")
    down = w.fill_down("t").to_df().toPandas().sort_values("event_id")
    up = w.fill_up("t").to_df().toPandas().sort_values("event_id")
    src = ev.toPandas().sort_values("event_id")
    src["v"] = src["t"].replace("", pd.NA)
    exp_down = src.groupby("g")["v"].ffill().fillna(src["t"])
    exp_up = src.groupby("g")["v"].bfill().fillna(src["t"])
    assert list(down["t"]) == list(exp_down)
    assert list(up["t"]) == list(exp_up)
    rid = w.with_row_id().to_df().toPandas().sort_values("event_id")
    assert list(rid["row_id"]) == list(src.groupby("g").cumcount())


def test_delete_rows_and_translate(spark, buckets):
    w = Wrangler(events(spark).select("event_id", "event_type"), order_by="event_id")
    kept = w.delete(rows=[0, 5, 9999]).to_df().toPandas()
    assert len(kept) == 9997 and not set(kept["event_id"]) & {0, 5, 9999}
    down = w.translate("event_type", "down", 2).ordered_df().toPandas()
    src = events(spark).select("event_id", "event_type").toPandas().sort_values("event_id")
    assert len(down) == len(src) + 2
    assert list(down["event_type"][:2]) == ["", ""]
    assert list(down["event_type"][2:]) == list(src["event_type"])
    assert list(down["event_id"][-2:]) == ["", ""]


def test_wrap_where_multi_column(spark, buckets):
    df = spark.createDataFrame([(0, "1", "2"), (1, "2", "4"), (2, "3", "5")],
                               "k long, a string, b string")
    w = Wrangler(df, order_by="k").drop("k").wrap(where="2")
    rows = [tuple(r) for r in w.ordered_df().collect()]
    assert rows == [("1", "", ""), ("2", "3", ""), ("2", "4", "5")]
    # first cell matching: no blank first row
    df2 = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "k long, a string")
    w2 = Wrangler(df2, order_by="k").drop("k")
    rows = [tuple(r) for r in w2.wrap(where="x").ordered_df().collect()]
    assert rows == [("x", "y"), ("x", "")]
    with pytest.raises(Exception):
        w2.wrap(where="x", width=1).to_df().collect()


def test_text_source_order_many_splits(spark, tmp_path):
    lines = {f"f{i}.txt": [f"{i}-{j},{j}" for j in range(300)] for i in range(3)}
    for name, ls in lines.items():
        (tmp_path / name).write_text("\n".join(ls) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        w = read_text(spark, str(tmp_path), cols=",")
        assert w.df.rdd.getNumPartitions() > 3
        got = [tuple(r) for r in w.with_row_id().ordered_df().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    exp_lines = [l for name in sorted(lines) for l in lines[name]]
    assert [(a + "," + b) for a, b, _ in got] == exp_lines
    assert [r for _, _, r in got] == list(range(len(exp_lines)))


def test_promote_demote_positions(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k long, s string")
    w = Wrangler(df, order_by="k")
    d = w.demote(5)  # after the last row
    rows = [tuple(r) for r in d.ordered_df().collect()]
    assert rows[-1] == ("k", "s") and len(rows) == 6
    p = w.promote(row=3)
    assert p.columns == ["3", "v3"]
    assert sorted(r[1] for r in p.to_df().collect()) == ["v0", "v1", "v2", "v4"]
    with pytest.raises(ValueError):
        w.promote(row=7)
    with pytest.raises(ValueError):
        w.promote(names=["a", "a"])


def test_streaming_frames_refuse_ordered_verbs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n")
    s = Wrangler(spark.readStream.format("text").load(str(tmp_path)))
    with pytest.raises(ValueError):
        s.fill_down()
    with pytest.raises(ValueError):
        s.split_all(",")


def test_deep_ordered_chain_is_checkpointed(spark):
    ev = events(spark).select("event_id", "event_type")
    w = Wrangler(ev, order_by="event_id")
    blanked = w.edit(fn=lambda c: F.when(c == "error", F.lit("")).otherwise(c), columns="event_type")
    two = blanked.fill_down("event_type").fill_up("event_type")
    assert two.depth == 2
    chain = two.with_row_id("a")  # third scan: the input is checkpointed first
    assert chain.depth == 1
    deeper = chain.with_row_id("b")
    assert deeper.depth == 2
    pdf = deeper.to_df().toPandas().sort_values("event_id")
    assert list(pdf["a"]) == list(pdf["b"]) == list(range(len(pdf)))
    src = ev.toPandas().sort_values("event_id")
    v = src["event_type"].replace("error", pd.NA)
    assert list(pdf["event_type"]) == list(v.ffill().bfill().fillna(""))
    # row-addressed verbs without a partition key use a key lookup, not a scan
    assert w.delete(rows=[0, 3]).depth == 0


def test_fill_row_per_partition(spark):
    ev = events(spark).select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(
            (F.col("user_id") % 5).cast("string")).alias("g"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")).alias("t"))
    w = Wrangler(ev, order_by="event_id", part="g")
    got = w.fill_row(2, [0, 1, 3, 4, 5], columns="t").to_df().toPandas().sort_values("event_id")
    src = ev.toPandas().sort_values("event_id")
    src["rn"] = src.groupby("g").cumcount()
    source = src[src["rn"] == 2].set_index("g")["t"]
    exp = [source.get(g, "") if (rn in (0, 1, 3, 4, 5) and t == "" and g in source.index) else t
           for g, rn, t in zip(src["g"], src["rn"], src["t"])]
    assert list(got["t"]) == exp


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_ordered_results_independent_of_shuffle_partitions(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        ev = events(spark).select("event_id", "event_type")
        w = Wrangler(ev, order_by="event_id")
        got = w.drop("event_id").wrap(where="error").to_df().toPandas()
        ids = w.with_row_id().to_df().toPandas().sort_values("event_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    src = ev.toPandas().sort_values("event_id")
    assert list(ids["row_id"]) == list(range(len(src)))
    # brute force W3 on one column
    rows, cur = [], []
    for v in src["event_type"]:
        if "error" in v and cur:
            rows.append(cur)
            cur = []
        cur.append(v)
    rows.append(cur)
    width = max(len(r) for r in rows)
    exp = sorted(tuple(r + [""] * (width - len(r))) for r in rows)
    assert sorted(tuple(r) for r in got.itertuples(index=False)) == exp


def test_null_partition_key_is_a_partition(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a", "" if i % 3 else f"v{i}")
                                for i in range(12)], "k long, g string, t string")
    w = Wrangler(df, order_by="k", part="g")
    got = {r["k"]: (r["row_id"], r["t"]) for r in
           w.fill_down("t").with_row_id().to_df().collect()}
    for g in ("a", None):
        ks = [k for k in range(12) if (None if k % 2 else "a") == g]
        last = ""
        for i, k in enumerate(ks):
            t = "" if k % 3 else f"v{k}"
            last = t or last
            assert got[k] == (i, last)


def test_hot_first_order_key_is_sub_bucketed(spark):
    # a third of all rows share the first order key
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).cast("long").alias("a"),
        (F.col("id") * 7 % 3001).alias("b"), F.col("id"))
    spark.conf.set("sheaf.order.buckets", "8")
    try:
        w = Wrangler(df, order_by=["a", "b"])
        bdf, bcols, _ = order_plan.bucketed(w)
        sizes = [r["count"] for r in bdf.groupBy(*bcols).count().collect()]
        got = w.with_row_id().to_df().toPandas()
    finally:
        spark.conf.unset("sheaf.order.buckets")
    assert max(sizes) < 3 * 3000 / 8  # the hot key is spread over several buckets
    exp = got.sort_values(["a", "b"]).reset_index(drop=True)
    assert list(exp["row_id"]) == list(range(3000))


def test_hot_string_first_order_key_is_sub_bucketed(spark):
    # a third of the rows share one string first key; others collide on the
    # surrogate bytes only after a long common prefix
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("shared-prefix-HOT"))
        .otherwise(F.concat(F.lit("shared-prefix-"), F.lpad(F.col("id").cast("string"), 6, "0")))
        .alias("a"),
        (F.col("id") * 7 % 3001).alias("b"), F.col("id"))
    spark.conf.set("sheaf.order.buckets", "8")
    try:
        w = Wrangler(df, order_by=["a", "b"])
        bdf, bcols, _ = order_plan.bucketed(w)
        sizes = [r["count"] for r in bdf.groupBy(*bcols).count().collect()]
        got = w.with_row_id().to_df().toPandas()
    finally:
        spark.conf.unset("sheaf.order.buckets")
    assert max(sizes) < 3 * 3000 / 8
    exp = got.sort_values(["a", "b"]).reset_index(drop=True)
    assert list(exp["row_id"]) == list(range(3000))


def test_hot_key_with_surrogate_collisions_keeps_order(spark):
    # every key shares its first 8 bytes, so all collide on the surrogate;
    # keys below ("...-0nnnn") and above ("...-znnnn") the hot value
    ids = F.lpad(F.col("id").cast("string"), 5, "0")
    a = (F.when(F.col("id") % 3 == 0, F.lit("MMMMMMMM-HOT"))
         .when(F.col("id") % 3 == 1, F.concat(F.lit("MMMMMMMM-0"), ids))
         .otherwise(F.concat(F.lit("MMMMMMMM-z"), ids)))
    df = spark.range(3000).select(F.lit("A").alias("x"), a.alias("a"),
                                  (F.col("id") * 7 % 3001).alias("b"))
    edge = spark.createDataFrame([("A", "A", 0), ("A", "Z", 0)], "x string, a string, b long")
    df = df.unionByName(edge.select(*[F.col(c).cast(t) for c, t in df.dtypes]))
    spark.conf.set("sheaf.order.buckets", "8")
    try:
        w = Wrangler(df, order_by=["a", "b"])
        bdf, bcols, _ = order_plan.bucketed(w)
        sizes = [r["count"] for r in bdf.groupBy(*bcols).count().collect()]
        got = w.with_row_id().to_df().toPandas()
    finally:
        spark.conf.unset("sheaf.order.buckets")
    assert max(sizes) < 3 * 3002 / 8
    exp = got.sort_values(["a", "b"]).reset_index(drop=True)
    assert list(exp["row_id"]) == list(range(len(exp)))


def test_wrap_where_row_major(spark):
    df = spark.createDataFrame([(0, "1", "2"), (1, "2", "4"), (2, "3", "5")],
                               "k long, a string, b string")
    w = Wrangler(df, order_by="k").drop("k").wrap(where="2", by="row")
    assert [tuple(r) for r in w.ordered_df().collect()] == [
        ("1", "", "", ""), ("2", "", "", ""), ("2", "4", "3", "5")]


@pytest.mark.parametrize("k", [8, 300, 400])
def test_row_ids_at_any_bucket_count(spark, k):
    # a hot first key in the middle, infinities, nulls and ties of the whole key
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).when(F.col("id") % 50 == 1, F.lit(float("inf")))
        .when(F.col("id") % 50 == 2, F.lit(float("-inf"))).when(F.col("id") % 50 == 7, F.lit(None).cast("double"))
        .otherwise(F.rand(3)).alias("a"), (F.col("id") * 7 % 5000).alias("b"), F.col("id"))
    df = spark.createDataFrame(df.collect(), df.schema).repartition(5)
    spark.conf.set("sheaf.order.buckets", str(k))
    try:
        w = Wrangler(df, order_by=["a", "b"])
        bdf, bcols, _ = order_plan.bucketed(w)
        sizes = [r["count"] for r in bdf.groupBy(*bcols).count().collect()]
        got = [tuple(r) for r in w.with_row_id().to_df().orderBy("row_id").collect()]
        filled = Wrangler(df.withColumn("v", F.when(F.col("id") % 9 == 0, F.col("id").cast("string")).otherwise("")),
                          order_by=["a", "b", "id"]).fill_down("v").to_df().collect()
    finally:
        spark.conf.unset("sheaf.order.buckets")
    assert [r[3] for r in got] == list(range(6000))
    low = float("-inf")
    keys = [((r[0] is not None, low if r[0] is None else r[0]), r[1]) for r in got]
    assert keys == sorted(keys)
    assert max(sizes) < 3 * 6000 / k + 20
    last, want = "", {}
    for r in sorted(filled, key=lambda r: ((r["a"] is not None, low if r["a"] is None else r["a"]), r["b"], r["id"])):
        last = str(r["id"]) if r["id"] % 9 == 0 else last
        want[r["id"]] = last
    assert {r["id"]: r["v"] for r in filled} == want


def test_outlier_strings_do_not_fill_one_bucket(spark):
    df = spark.range(20000).select(F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("s"))
    df = df.unionByName(spark.createDataFrame([("A",), ("Z",)], "s string"))
    w = Wrangler(df, order_by="s")
    bdf, bcols, _ = order_plan.bucketed(w)
    sizes = [r["count"] for r in bdf.groupBy(*bcols).count().collect()]
    assert max(sizes) < 3 * 20002 / 16
    got = w.with_row_id().to_df().orderBy("row_id").collect()
    assert [r["s"] for r in got] == sorted(r["s"] for r in got)


def test_overwritten_folder_is_read_anew(spark, tmp_path):
    for prefix in ("aaaa", "bbbbbbbb-"):
        path = str(tmp_path / "t")
        spark.range(1000).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("s")).write.mode("overwrite").parquet(path)
        got = Wrangler(spark.read.parquet(path), order_by="s").with_row_id().to_df().collect()
        want = {s: i for i, s in enumerate(sorted(r["s"] for r in got))}
        assert {r["s"]: r["row_id"] for r in got} == want


def test_rows_are_addressed_alike_at_any_index(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    w = Wrangler(df, order_by="k")
    assert w.delete(rows=[0]).to_df().count() == 2  # ties are rows of their own
    assert w.delete(rows=[]).to_df().count() == 3
    with pytest.raises(ValueError, match="out of range"):
        w.delete(rows=[0, 1000])
    many = Wrangler(spark.range(3000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v")), order_by="k")
    left = {r["k"] for r in many.delete(rows=[0, 999, 1000, 2999]).to_df().collect()}
    assert left == set(range(3000)) - {0, 999, 1000, 2999}


def _sizes(w):
    bdf, bcols, _ = order_plan.bucketed(w)
    return [r["count"] for r in bdf.groupBy(*bcols).count().collect()]


@pytest.mark.parametrize("k", [16, 400])
@pytest.mark.parametrize("shape", ["few", "hot"])
def test_equal_keys_are_cut_by_their_tie_order(spark, k, shape):
    n = 40000
    key = F.col("id") % 200 if shape == "few" else F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id"))
    df = spark.range(n).select(key.alias("a"), F.col("id").cast("string").alias("v"))
    spark.conf.set("sheaf.order.buckets", str(k))
    try:
        w = Wrangler(df, order_by="a")
        sizes = _sizes(w)
        ids = w.with_row_id().to_df().orderBy("row_id").collect()
        again = w.with_row_id().to_df().orderBy("row_id").collect()
    finally:
        spark.conf.unset("sheaf.order.buckets")
    assert sum(sizes) == n and max(sizes) < 3 * n / k + 60
    assert [r["row_id"] for r in ids] == list(range(n)) and ids == again
    assert [r["a"] for r in ids] == sorted(r["a"] for r in ids)


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_an_ordered_verb_reads_and_moves_its_input_once(spark):
    w = Wrangler(events(spark).select("event_id", "event_type"), order_by="event_id")
    for out in (w.fill_down("event_type", blank="error"), w.fill_up("event_type", blank="error"), w.with_row_id()):
        plan = _plan(out.to_df())
        assert plan.count("FileScan") == 1 and "SortAggregate" not in plan
        assert plan.count("ReusedExchange") >= 1


def test_rows_by_number_move_no_rows(spark):
    w = Wrangler(events(spark).select("event_id", "event_type", "user_id"), order_by="event_id")
    for out in (w.delete(rows=[0, 7, 100]), w.cut(on="e", row=[3], columns="event_type"), w.edit(value="x", rows=[5]),
                w.fill_row(3, [4, 5], blank="error"), w.promote(row=2)):
        assert "Exchange" not in _plan(out.to_df())


@pytest.mark.parametrize("top", [order_plan.NEAR_TOP, 5])
def test_rows_by_number_with_ties_and_equal_rows(spark, monkeypatch, top):
    """Addressed rows: alone, tied on the key, equal to others in every column; top and far."""
    monkeypatch.setattr(order_plan, "NEAR_TOP", top)
    rows = [(None if i < 3 else i // 4, f"v{i % 7}") for i in range(200)] + [(60, "same")] * 30
    df = spark.createDataFrame(rows, "k int, v string").repartition(3)
    w = Wrangler(df, order_by="k")
    full = [tuple(r) for r in w.with_row_id().to_df().orderBy("row_id").collect()]
    for asked in ([0], [1, 2], [50, 51], [7, 198], [205], [200, 229], list(range(40, 60))):
        left = sorted(map(repr, (tuple(r) for r in w.delete(rows=asked).to_df().collect())))
        assert left == sorted(repr(r[:2]) for r in full if r[2] not in asked), asked
        marked = sorted(map(repr, (tuple(r) for r in w.edit(value="!", columns="v", rows=asked).to_df().collect())))
        assert marked == sorted(repr((r[0], "!" if r[2] in asked else r[1])) for r in full), asked
    with pytest.raises(ValueError, match="out of range"):
        w.delete(rows=[230])
    spark.conf.set("sheaf.order.buckets", "9")
    try:
        known = w.with_row_id("n")  # bounds with a tie part, known before
        assert known.delete(rows=[40, 199]).to_df().count() == 228
    finally:
        spark.conf.unset("sheaf.order.buckets")


def test_text_rows_are_numbered_without_moving_lines(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"f{f}.txt").write_text("".join(f"@{f}-{j},x\n" for j in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        w = read_text(spark, str(tmp_path), cols=",", width=2)
        plan = _plan(w.with_row_id().to_df())
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert not any("c0" in line for line in moved) and "BroadcastHashJoin" in plan
        assert "ENSURE_REQUIREMENTS" not in "".join(line for line in moved if "c0" in line)
        got = [tuple(r) for r in w.with_row_id().to_df().orderBy("row_id").collect()]
        kept = w.delete(rows=[0, 700]).with_row_id().to_df().orderBy("row_id").collect()
        wrapped = [tuple(r) for r in w.drop("c1").wrap_rows(4).ordered_df().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [f"@{f}-{j}" for f in range(3) for j in range(500)]
    assert [r[0] for r in got] == want and [r[2] for r in got] == list(range(1500))
    assert [r["c0"] for r in kept] == [x for i, x in enumerate(want) if i not in (0, 700)]
    assert [r["row_id"] for r in kept] == list(range(1498))
    assert wrapped == [tuple(want[i:i + 4]) for i in range(0, 1500, 4)]


def test_unfold_places_many_values(spark):
    import random
    rng = random.Random(8)
    rows = [(i, f"g{rng.randint(0, 20)}", None if rng.random() < 0.05 else f"k{rng.randint(0, 120)}", f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, g string, k string, v string")
    w = Wrangler(df, order_by="i").drop("i")
    want = {}
    for _, g, k, v in rows:
        want.setdefault(g, {}).setdefault("null" if k is None else k, v)
    out = w.unfold("k", "v").to_df()
    names = [c for c in out.columns if c != "g"]
    assert len(names) == len({k for d in want.values() for k in d})
    assert {r["g"]: {c: r[c] for c in names if r[c]} for r in out.collect()} == want
    some = w.unfold("k", "v", values=["k3", "absent", None]).to_df()  # other values only keep their row
    assert some.columns == ["g", "k3", "absent", "null"]
    assert {tuple(r) for r in some.collect()} == {(g, d.get("k3", ""), "", d.get("null", "")) for g, d in want.items()}


@pytest.mark.parametrize("k", ["1", "7"])
def test_translate_column_across_buckets(spark, k):
    """Shifts shorter and longer than a bucket, and than the table."""
    import random
    spark.conf.set("sheaf.order.buckets", k)
    try:
        for n in (0, 1, 60):
            ks = list(range(n))
            random.Random(n).shuffle(ks)
            df = spark.createDataFrame([(i, f"a{i}", None if i % 9 == 0 else f"b{i}") for i in ks], "k int, a string, b string")
            w = Wrangler(df, order_by="k").drop("k")
            a, b = [f"a{i}" for i in range(n)], ["" if i % 9 == 0 else f"b{i}" for i in range(n)]
            for d in (1, 20, 100):
                down = [tuple(r) for r in w.translate("b", "down", d).ordered_df().collect()]
                assert down == list(zip(a + [""] * d, [""] * d + b))
                up = [tuple(r) for r in w.translate("b", "up", d).ordered_df().collect()]
                assert up == list(zip(a, (b[d:] + [""] * n)[:n]))
    finally:
        spark.conf.unset("sheaf.order.buckets")


def test_columns_that_cannot_be_hashed(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.create_map(F.lit("a"), "id").alias("m"),
                                F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise("").alias("v"))
    got = Wrangler(df, order_by="k").fill_down("v").with_row_id().to_df().orderBy("row_id").collect()
    assert [r["k"] for r in got] == list(range(50)) and {r["v"] for r in got} == {"x"} and got[7]["m"] == {"a": 7}
