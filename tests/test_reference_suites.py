"""The reference's example suites, ported with exact shape checks (FIXTURES.md §1)."""

from sheaf import re_, read_text
from tests.conftest import rows

T2X3 = "1,3,5\n2,4,6\n"
FILL = "1,2\n,3\n4,\n5,6\n,\n"
WRAP = "1,2\n2,4\n3,5\n"
EASY_SPLIT = "1i2,3i4\n5i6,7i8\n"
PROMOTE = "Goodbye,Universe\nHello,World\n"
CUT = ("INT,STRING,REGEX,TUPLE_ON,TUPLE_BETWEEN\n"
       "abcok123ay456,abcok123ay456,abcok123ay456,abcok123ay456,abcok123ay456\n"
       "defOKBNMAY789,defOKBNMAY789,defOKBNMAY789,defOKBNMAY789g89,defOKBNMA789Y\n")


def load(spark, textfile, content):
    return read_text(spark, textfile(content), cols=",")


def test_drop(spark, textfile):
    w = load(spark, textfile, T2X3).drop(1)
    assert rows(w) == [["1", "5"], ["2", "6"]]


def test_edit(spark, textfile):
    w = load(spark, textfile, T2X3).edit(value="4", columns=[1, 2])
    assert rows(w) == [["1", "4", "4"], ["2", "4", "4"]]


def test_merge(spark, textfile):
    w = load(spark, textfile, T2X3).merge((0, 1), glue="+")
    assert rows(w) == [["1+3", "5"], ["2+4", "6"]]


def test_translate_down(spark, textfile):
    w = load(spark, textfile, T2X3).translate(distance=2)
    assert rows(w) == [["", "", ""], ["", "", ""], ["1", "3", "5"], ["2", "4", "6"]]


def test_delete_regex(spark, textfile):
    w = load(spark, textfile, T2X3)
    assert rows(w.delete(columns=1, where=re_(".2"))) == [["1", "3", "5"], ["2", "4", "6"]]
    assert rows(w.delete(columns=1, where="4")) == [["1", "3", "5"]]


def test_transpose(spark, textfile):
    w = load(spark, textfile, T2X3).transpose()
    assert rows(w) == [["1", "2"], ["3", "4"], ["5", "6"]]
    assert rows(w.transpose()) == [["1", "3", "5"], ["2", "4", "6"]]


def test_fill_down(spark, textfile):
    w = load(spark, textfile, FILL).fill()
    assert rows(w) == [["1", "2"], ["1", "3"], ["4", "3"], ["5", "6"], ["5", "6"]]


def test_wrap_where(spark, textfile):
    w = load(spark, textfile, WRAP).wrap(where="2")
    assert rows(w) == [["1", "", ""], ["2", "3", ""], ["2", "4", "5"]]


def test_split_between_all_merge(spark, textfile):
    # Only column 0 contains the range, as in the reference where a split that
    # matches nowhere adds no column; ours always gives two columns.
    w = load(spark, textfile, EASY_SPLIT)
    w = w.split(after="1", before="2", columns=0)
    w = w.split(on=["i", "GH"], max="all")
    w = w.merge((1, 2), glue="")
    assert rows(w) == [["1", "2", "3", "4"], ["5", "6", "7", "8"]]


def test_split_all_columns_shape(spark, textfile):
    w = load(spark, textfile, EASY_SPLIT)
    w = w.split(after="1", before="2")
    assert rows(w) == [["1", "2", "3i4", ""], ["5i6", "", "7i8", ""]]


def test_promote_demote(spark, textfile):
    w = load(spark, textfile, PROMOTE).promote(row=1)
    assert w.columns == ["Hello", "World"]
    d = w.demote(1)
    assert d.columns == ["c0", "c1"]
    assert rows(d) == [["Goodbye", "Universe"], ["Hello", "World"]]
    p = d.promote(row=0)
    assert p.columns == ["Goodbye", "Universe"]
    assert rows(p) == [["Hello", "World"]]


def test_cut_chain(spark, textfile):
    w = load(spark, textfile, CUT).promote(row=0)
    w = w.cut(before="o").cut(on="123").cut(after="y")
    w = w.cut(columns="INT", row=1, before=3)
    w = w.cut(columns="INT", row=1, on=[2, 3, 4])
    w = w.cut(columns=0, after=4)
    w = w.cut(columns="STRING", row=1, before="O")
    w = w.cut(columns="STRING", row=1, on=["B", "M", "N"])
    w = w.cut(columns=1, after="Y")
    w = w.cut(columns="REGEX", row=1, before=re_("O"))
    w = w.cut(columns="REGEX", row=1, on=[re_("NM"), re_("B")])
    w = w.cut(columns=2, after=re_("Y"))
    w = w.cut(columns="TUPLE_ON", row=1, on=(0, 2))
    w = w.cut(columns="TUPLE_ON", row=1, on=(2, re_("NM")))
    w = w.cut(columns=3, on=(re_(".8"), "9"), max="all")
    w = w.cut(columns="TUPLE_BETWEEN", row=1, after=-1, before=3)
    w = w.cut(columns="TUPLE_BETWEEN", row=1, between=(1, "A78"))
    w = w.cut(columns=4, between=(re_("A"), "Y"), max="all")
    assert rows(w) == [["okay"] * 5, ["OKAY"] * 5]
