import pytest
"""Row-local verbs vs a pure-Python model on random strings (SURVEY §5 (c))."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sheaf import Wrangler, re_

ALPHABET = ["a", "b", "e", ",", ".", "|", "*", "(", " ", "\n", "é", "😀", "ab"]
DELIMS = ["a", ",", ".", "|", "*", "ab", "😀", "(", "aa"]
cells = st.lists(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join),
                 min_size=1, max_size=40)
SETTINGS = settings(max_examples=4, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, s string")
    return Wrangler(df, order_by="k")


def got(w):
    return [tuple(r)[1:] for r in w.ordered_df(with_part=False).collect()]


def jsplit(s, d):
    if s == "":
        return [""]
    parts = s.split(d)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


@SETTINGS
@given(values=cells, d=st.sampled_from(DELIMS), i=st.integers(0, 6))
def test_cut_family(spark, values, d, i):
    w = frame(spark, values)
    assert got(w.cut_index(i, "s")) == [(v[:i] + v[i + 1:] if len(v) > i else v,) for v in values]
    assert got(w.cut_all(d, "s")) == [(v.replace(d, ""),) for v in values]

    def right(v):
        j = v.rfind(d)
        return v if j < 0 else v[:j] + v[j + len(d):]

    assert got(w.cut_right(d, "s")) == [(right(v),) for v in values]
    assert got(w.cut_before(i, "s")) == [(v[i:] if len(v) > i else v,) for v in values]

    def first(v):
        j = v.find(d)
        return v if j < 0 else v[:j] + v[j + len(d):]

    assert got(w.cut(on=d, columns="s")) == [(first(v),) for v in values]
    assert got(w.cut_regex(re_(d).pattern.replace("|", "\\|").replace(".", "\\.")
                           .replace("*", "\\*").replace("(", "\\("), "s")) == [
        (first(v),) for v in values]
    assert got(w.cut(after=d, columns="s")) == [
        (v[:v.find(d) + len(d)] if d in v else v,) for v in values]
    assert got(w.cut(before=d, columns="s")) == [(v[v.find(d):] if d in v else v,) for v in values]
    assert got(w.cut(after=i, columns="s")) == [(v[:i] if len(v) > i else v,) for v in values]
    assert got(w.cut(before=i, columns="s")) == [(v[i:] if len(v) > i else "",) for v in values]


@SETTINGS
@given(values=cells, a=st.sampled_from(["a", ",", "(", "ab"]),
       b=st.sampled_from(["b", ".", "*", "a"]))
def test_cut_ranges(spark, values, a, b):
    w = frame(spark, values)

    def on(v):  # the end is searched from the start of the first match
        i = v.find(a)
        if i < 0:
            return v
        j = v.find(b, i)
        return v if j < 0 else v[:i] + v[j + len(b):]

    def between(v):
        i = v.find(a)
        if i < 0:
            return v
        j = v.find(b, i + len(a))
        return v if j < 0 else v[:i + len(a)] + v[j:]

    assert got(w.cut(on=(a, b), columns="s")) == [(on(v),) for v in values]
    assert got(w.cut(between=(a, b), columns="s")) == [(between(v),) for v in values]


@SETTINGS
@given(values=cells, d=st.sampled_from(DELIMS), i=st.integers(0, 6))
def test_split_extract_family(spark, values, d, i):
    w = frame(spark, values)

    def at(v, j, n):
        return (v[:j], v[j + n:]) if j >= 0 else (v, "")

    assert got(w.split_value(d, "s")) == [at(v, v.find(d), len(d)) for v in values]
    assert got(w.split_right(d, "s")) == [at(v, v.rfind(d), len(d)) for v in values]
    assert got(w.split_index(i, "s")) == [at(v, i if len(v) > i else -1, 1) for v in values]
    assert got(w.extract_value(d, "s")) == [(v, d if d in v else "") for v in values]
    assert got(w.extract_index(i, "s")) == [(v, v[i] if len(v) > i else "") for v in values]
    assert got(w.extract(on=d, columns="s")) == [
        ((v[:v.find(d)] + v[v.find(d) + len(d):], d) if d in v else (v, "")) for v in values]
    # JVM split semantics with width discovery
    pieces = [jsplit(v, d) for v in values]
    width = max(1, max(len(p) for p in pieces))
    assert got(w.split(on=d, max="all", columns="s")) == [
        tuple(p + [""] * (width - len(p))) for p in pieces]


def test_jvm_split_edges(spark):
    w = frame(spark, ["", ",", ",a", "a,,", "a,b", "😀,x,", "a,,\n", "x\n,"])
    assert got(w.split_all(",", "s")) == [("", "", ""), ("", "", ""), ("", "a", ""), ("a", "", ""),
                                          ("a", "b", ""), ("😀", "x", ""), ("a", "", "\n"),
                                          ("x\n", "", "")]
    # multi-character delimiters take the general path
    w2 = frame(spark, ["baaa", "aa", "xaay"])
    assert got(w2.split_all("aa", "s")) == [("b", "a"), ("", ""), ("x", "y")]
    # an explicit width that some row exceeds fails instead of merging or dropping pieces
    with pytest.raises(Exception, match="more than width=1"):
        w.split_all(",", "s", width=1).to_df().collect()
    assert got(w.split_all(",", "s", width=4))[0] == ("", "", "", "")


def test_back_references_keep_their_numbers(spark):
    w = frame(spark, ["abccd", "aabb", "abc"])
    assert got(w.cut_regex(r"(.)\1", "s")) == [("abd",), ("bb",), ("abc",)]
    assert got(w.cut(after=re_(r"(.)\1"), columns="s")) == [("abcc",), ("aa",), ("abc",)]
    assert got(w.cut(before=re_(r"(.)\1"), columns="s")) == [("ccd",), ("aabb",), ("abc",)]
    assert got(w.split(on=re_(r"(.)\1"), columns="s")) == [("ab", "d"), ("", "bb"), ("abc", "")]
    assert got(w.cut_regex("b*", "s")) == [("abccd",), ("aabb",), ("abc",)]  # the first match is empty
    assert got(frame(spark, ["xaay11z"]).cut(between=(re_(r"(a)\1"), re_(r"(1)\1")), max="all", columns="s")) == [("xaa11z",)]


def test_split_all_after_and_before(spark):
    w = frame(spark, ["x12a34b", "12", "abc", ""])
    assert got(w.split(after=re_("[0-9]{1,5}"), max="all", columns="s")) == [
        ("x12", "a34", "b"), ("12", "", ""), ("abc", "", ""), ("", "", "")]
    assert got(w.split(before=re_("[0-9]+"), max="all", columns="s")) == [
        ("x", "12a", "34b"), ("12", "", ""), ("abc", "", ""), ("", "", "")]


def test_split_specs(spark):
    w = frame(spark, ["okay4okay3okay", "okay56okay", "okay12okay12okay"])
    # C14 order: positions descending, then literals in reverse listing order
    assert got(w.split(on=["3", "4"], columns="s")) == [
        ("okay", "okay", "okay"), ("okay56okay", "", ""), ("okay12okay12okay", "", "")]
    assert got(w.split(on=re_("[0-9]+"), max="all", columns="s")) == [
        ("okay", "okay", "okay"), ("okay", "okay", ""), ("okay", "okay", "okay")]
    assert got(w.split(after="y", columns="s")) == [
        ("okay", "4okay3okay"), ("okay", "56okay"), ("okay", "12okay12okay")]
    assert got(w.split(before=re_("[0-9]"), columns="s")) == [
        ("okay", "4okay3okay"), ("okay", "56okay"), ("okay", "12okay12okay")]
    assert got(w.extract(on=re_("[0-9]"), max="all", columns="s")) == [
        ("okayokayokay", "4", "3", "", ""), ("okayokay", "5", "6", "", ""),
        ("okayokayokay", "1", "2", "1", "2")]
    assert got(w.split(on=(2, "o"), columns="s")) == [
        ("ok", "kay3okay"), ("ok", "kay"), ("ok", "kay12okay")]


def test_nulls_and_types(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "x,y", 6)], "k long, s string, n int")
    w = Wrangler(df, order_by="k")
    assert got(w.cut_all(",", "s")) == [(None, 5), ("xy", 6)]
    assert got(w.split_value(",", "s")) == [(None, None, 5), ("x", "y", 6)]
    # delete: a null predicate keeps the row
    assert got(w.delete(pred=lambda c: c.contains("x"), columns="s")) == [(None, 5)]
    # merge treats null as ''
    assert got(w.merge(["s", "n"], glue="-")) == [("-5",), ("x,y-6",)]
    # non-string columns are cut as text
    assert got(w.cut_index(0, "n")) == [(None, ""), ("x,y", "")]


def test_fill_sideways_and_edit(spark):
    df = spark.createDataFrame([(0, "a", "", "c"), (1, "", "", "z"), (2, "", "q", "")],
                               "k long, x string, y string, z string")
    w = Wrangler(df, order_by="k")
    xyz = ["x", "y", "z"]
    assert got(w.fill_left(xyz)) == [("a", "a", "c"), ("", "", "z"), ("", "q", "q")]
    assert got(w.fill_right(xyz)) == [("a", "c", "c"), ("z", "z", "z"), ("q", "q", "")]
    assert got(w.fill_left(xyz, rows=[0])) == [("a", "a", "c"), ("", "", "z"), ("", "q", "")]
    assert got(w.fill_column("z", "x")) == [("a", "", "c"), ("z", "", "z"), ("", "q", "")]
    assert got(w.fill_down(blank="a")) == [("a", "", "c"), ("", "", "z"), ("", "q", "")]
    assert got(w.edit(value="E", columns=["x", "z"], rows=[1])) == [
        ("a", "", "c"), ("E", "", "E"), ("", "q", "")]
    assert got(w.fill_row(0, [1, 2])) == [("a", "", "c"), ("a", "", "z"), ("a", "q", "c")]


def test_column_handle_and_python_udf(spark):
    from sheaf.functions.udf import cell_fn, cell_pred

    w = frame(spark, ["2024-01-01 10:00", "bad", None])
    s = w["s"].split_value(" ")
    assert s.columns == ["k", "s_1", "s_2"]
    boom = cell_fn(lambda v: v.split(" ")[1])
    # an exception in the Python function leaves the cell unchanged
    assert got(w.cut_fn(boom, "s")) == [("2024-01-01 ",), ("bad",), (None,)]
    assert got(w.delete(pred=cell_pred(lambda v: v.startswith("b")), columns="s")) == [
        ("2024-01-01 10:00",), (None,)]


def test_handle_split_then_rename(spark):
    w = frame(spark, ["2024-01-01 10:00", "2024-02-03 11:30"])
    r = w["s"].split_value(" ").rename(("DATE", "TIME"))
    assert r.columns == ["k", "DATE", "TIME"]
    assert got(r) == [("2024-01-01", "10:00"), ("2024-02-03", "11:30")]
    assert r.rename({"TIME": "T"}).columns == ["k", "DATE", "T"]


def test_lookaround_and_range_all_forms(spark):
    w = frame(spark, ["a-b-c", "x", "{k:1}{j:2}"])
    assert got(w.split(after="-", max="all", columns="s")) == [
        ("a-", "b-", "c"), ("x", "", ""), ("{k:1}{j:2}", "", "")]
    assert got(w.split(before="-", max="all", columns="s")) == [
        ("a", "-b", "-c"), ("x", "", ""), ("{k:1}{j:2}", "", "")]
    assert got(w.extract(between=("{", "}"), max="all", columns="s")) == [
        ("a-b-c", "", ""), ("x", "", ""), ("{}{}", "k:1", "j:2")]
    assert got(w.cut(on=("{", ":"), max="all", columns="s")) == [("a-b-c",), ("x",), ("1}2}",)]
    assert got(w.cut(after=re_("-[a-z]"), columns="s")) == [("a-b",), ("x",), ("{k:1}{j:2}",)]
    assert got(w.cut(before=re_("[0-9]"), columns="s")) == [("a-b-c",), ("x",), ("1}{j:2}",)]
    # the end is searched from the start of the first match, so it may be that match
    assert got(w.split(on=("-", "-"), columns="s")) == [("a", "b-c"), ("x", ""), ("{k:1}{j:2}", "")]


# -- ranges, left to right ------------------------------------------------------

RANGES = [("a+", "b"), ("a", "b"), ("a+", "ab"), ("(a)(1)?", "b|1"), ("x?a", "(b)\\1?"), ("ab|b+", "b")]


def ranges_of(text, a, b):
    """(end of the start, begin of the end) of every range, by searching place after place."""
    import re
    out, at, kept = [], 0, 0
    a, b = re.compile(a), re.compile(b)
    while at <= len(text):
        m = a.match(text, at)
        e = b.search(text, m.end()) if m else None
        if e and e.start() > m.end():
            out.append((m.end(), e.start()))
            at = e.start()
        else:
            at += 1
    return out


def test_ranges_equal_a_plain_search(spark):
    import random
    rng = random.Random(4)
    texts = ["xaa1bz", "abccd", "abxb", "aab", "", "a", "aXb aYb", "aa1bbaa2b"] + [
        "".join(rng.choice("ab1x ") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, s string")
    w = Wrangler(df)
    for a, b in RANGES:
        spec = {"between": (re_(a), re_(b)), "columns": "s", "max": "all"}
        found = {t: ranges_of(t, a, b) for t in texts}
        split, cut, out = ([list(r) for r in sorted(x.to_df().collect(), key=lambda r: r[0])]
                           for x in (w.split(**spec), w.cut(**spec), w.extract(**spec)))
        for i, t in enumerate(texts):
            edges = [0, *[x for r in found[t] for x in r], len(t)]
            pieces = [t[edges[j]:edges[j + 1]] for j in range(0, len(edges), 2)]
            width = len(split[i]) - 1
            assert split[i][1:] == pieces + [""] * (width - len(pieces)), (a, b, t)
            assert cut[i][1] == "".join(pieces), (a, b, t)
            mid = [t[x:y] for x, y in found[t]]
            assert out[i][1:] == ["".join(pieces), *mid] + [""] * (len(out[i]) - 2 - len(mid)), (a, b, t)


def test_range_stays_stated(spark):
    df = spark.createDataFrame([("xaa1bz",), ("abccd",), (None,)], "s string")
    w = Wrangler(df)
    two = lambda x: [tuple(r) for r in x.to_df().collect()]
    assert two(w.split(between=(re_("a+"), re_("b")))) == [("xaa", "bz"), ("abccd", ""), (None, None)]
    assert two(w.extract(between=(re_("a+"), "b"))) == [("xaabz", "1"), ("abccd", ""), (None, None)]
    assert two(w.extract(on=("a", "b"))) == [("xz", "aa1b"), ("ccd", "ab"), (None, None)]
    assert two(w.split(on=[re_("a+"), "b"])) == [("x", "1", "z"), ("", "", "ccd"), (None, None, None)]


def test_ranges_bind_what_they_find_once(spark):
    from sheaf.plans.catalogue import queries
    for name, token, most in [("extract_range", "instr(", 4), ("split_regex", "split(", 2)]:
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count(token) <= most, plan
