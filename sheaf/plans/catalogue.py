"""Query catalogue: every verb exercised on the driver tables, with its DuckDB oracle.

Each entry maps a name to ``(spark_fn, oracle_sql)``; ``spark_fn(spark, sf_dir)``
returns a DataFrame over whole tables (no sampling, no row caps). The oracle
is plain SQL over the same tables; ``None`` means not SQL-expressible with a
static result schema (checked against a brute-force model in the tests).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import PART, Wrangler
from ..functions.udf import cell_fn
from ..match import re_
from ..sources.tables import read_table
from ..sources.text import lines_from
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str, cols=None) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", cols)


def W(spark, d, name, cols, order_by=None, part=None) -> Wrangler:
    """Wrangler over ``cols`` of a table; order / partition keys that are not
    output columns are read too and kept only in their hidden copies."""
    keys = [k for k in ([order_by] if isinstance(order_by, str) else (order_by or []))
            if isinstance(k, str)]
    if isinstance(part, str):
        keys.append(part)
    extra = [k for k in dict.fromkeys(keys) if k not in cols]
    w = Wrangler(table(spark, d, name, [*cols, *extra]), order_by=order_by, part=part)
    return w.drop(extra) if extra else w


# ---------------------------------------------------------------- cut

@query("cut_regex_first", """
SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '') AS p_name FROM part""")
def cut_regex_first(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_name"]).cut_regex("[aeiou]", "p_name").to_df()


@query("cut_all_literal", """
SELECT doc_id, replace(text, chr(10), '') AS text FROM documents""")
def cut_all_literal(spark, d):
    return W(spark, d, "documents", ["doc_id", "text"]).cut_all("\n", "text").to_df()


@query("cut_right", r"""
SELECT p_partkey, regexp_replace(p_name, '^(.*)e', '\1') AS p_name FROM part""")
def cut_right(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_name"]).cut_right("e", "p_name").to_df()


@query("cut_index", """
SELECT p_partkey,
       CASE WHEN length(p_name) > 2 THEN substr(p_name, 1, 2) || substr(p_name, 4)
            ELSE p_name END AS p_name
FROM part""")
def cut_index(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_name"]).cut_index(2, "p_name").to_df()


@query("cut_before", """
SELECT c_custkey, CASE WHEN length(c_name) > 13 THEN substr(c_name, 14) ELSE c_name END AS c_name
FROM customer""")
def cut_before(spark, d):
    return W(spark, d, "customer", ["c_custkey", "c_name"]).cut_before(13, "c_name").to_df()


@query("cut_after_literal", """
SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, 1, strpos(url, '://') + 2)
                     ELSE url END AS url
FROM pages""")
def cut_after_literal(spark, d):
    return W(spark, d, "pages", ["page_id", "url"]).cut(after="://", columns="url").to_df()


@query("cut_before_literal", """
SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://'))
                     ELSE url END AS url
FROM pages""")
def cut_before_literal(spark, d):
    return W(spark, d, "pages", ["page_id", "url"]).cut(before="://", columns="url").to_df()


@query("cut_literal_first", """
SELECT p_partkey, CASE WHEN strpos(p_name, 'e') > 0
                       THEN substr(p_name, 1, strpos(p_name, 'e') - 1) || substr(p_name, strpos(p_name, 'e') + 1)
                       ELSE p_name END AS p_name
FROM part""")
def cut_literal_first(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_name"]).cut(on="e", columns="p_name").to_df()


@query("cut_regex_all", """
SELECT event_id, regexp_replace(props, '[0-9]', '', 'g') AS props FROM events""")
def cut_regex_all(spark, d):
    return (W(spark, d, "events", ["event_id", "props"])
            .cut(on=re_("[0-9]"), max="all", columns="props").to_df())


@query("cut_int_after", """
SELECT p_partkey, CASE WHEN length(p_type) > 3 THEN left(p_type, 3) ELSE p_type END AS p_type
FROM part""")
def cut_int_after(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_type"]).cut(after=3, columns="p_type").to_df()


@query("cut_int_before", """
SELECT p_partkey, CASE WHEN length(p_type) > 3 THEN substr(p_type, 4) ELSE '' END AS p_type
FROM part""")
def cut_int_before(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_type"]).cut(before=3, columns="p_type").to_df()


@query("cut_on_range", r"""
SELECT event_id, regexp_replace(props, '\{(?s:.*?):', '') AS props FROM events""")
def cut_on_range(spark, d):
    return W(spark, d, "events", ["event_id", "props"]).cut(on=("{", ":"), columns="props").to_df()


@query("cut_between", r"""
SELECT event_id, regexp_replace(props, '\{(?s:.*?):', '{:') AS props FROM events""")
def cut_between(spark, d):
    return (W(spark, d, "events", ["event_id", "props"])
            .cut(between=("{", ":"), columns="props").to_df())


@query("cut_range_all", """
SELECT page_id, regexp_replace(html, '<(?s:.*?)>', '', 'g') AS html FROM pages""")
def cut_range_all(spark, d):
    return (W(spark, d, "pages", ["page_id", "html"])
            .cut(on=("<", ">"), max="all", columns="html").to_df())


@query("cut_list_order", """
WITH s1 AS (SELECT o_orderkey, CASE WHEN length(o_orderpriority) > 1
                 THEN substr(o_orderpriority, 1, 1) || substr(o_orderpriority, 3)
                 ELSE o_orderpriority END AS x FROM orders),
     s2 AS (SELECT o_orderkey, CASE WHEN length(x) > 0 THEN substr(x, 2) ELSE x END AS x FROM s1),
     s3 AS (SELECT o_orderkey, CASE WHEN strpos(x, 'E') > 0
                 THEN substr(x, 1, strpos(x, 'E') - 1) || substr(x, strpos(x, 'E') + 1)
                 ELSE x END AS x FROM s2)
SELECT o_orderkey, CASE WHEN strpos(x, 'LOW') > 0
                 THEN substr(x, 1, strpos(x, 'LOW') - 1) || substr(x, strpos(x, 'LOW') + 3)
                 ELSE x END AS o_orderpriority
FROM s3""")
def cut_list_order(spark, d):
    # C14: positions descending first (1 then 0), then literals in reverse order
    return (W(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
            .cut(on=[1, 0, "LOW", "E"], columns="o_orderpriority").to_df())


@query("cut_fn", """
WITH t AS (SELECT p_partkey, p_brand, split_part(p_brand, '#', 1) AS r FROM part)
SELECT p_partkey,
       CASE WHEN strpos(p_brand, r) > 0
            THEN substr(p_brand, 1, strpos(p_brand, r) - 1) || substr(p_brand, strpos(p_brand, r) + length(r))
            ELSE p_brand END AS p_brand
FROM t""")
def cut_fn(spark, d):
    return (W(spark, d, "part", ["p_partkey", "p_brand"])
            .cut_fn(lambda c: F.substring_index(c, "#", 1), "p_brand").to_df())


@query("cut_pyfn", """
WITH t AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS r FROM part)
SELECT p_partkey,
       CASE WHEN strpos(p_name, r) > 0
            THEN substr(p_name, 1, strpos(p_name, r) - 1) || substr(p_name, strpos(p_name, r) + length(r))
            ELSE p_name END AS p_name
FROM t""")
def cut_pyfn(spark, d):
    # An arbitrary Python cell function, Arrow-batched
    return (W(spark, d, "part", ["p_partkey", "p_name"])
            .cut_fn(cell_fn(lambda s: s.split(" ")[0]), "p_name").to_df())


@query("cut_row", """
SELECT p_partkey,
       CASE WHEN row_number() OVER (ORDER BY p_partkey) - 1 IN (0, 1, 7, 100)
                 AND strpos(p_name, 'e') > 0
            THEN substr(p_name, 1, strpos(p_name, 'e') - 1) || substr(p_name, strpos(p_name, 'e') + 1)
            ELSE p_name END AS p_name
FROM part""")
def cut_row(spark, d):
    return (W(spark, d, "part", ["p_partkey", "p_name"], order_by="p_partkey")
            .cut(on="e", columns="p_name", row=[0, 1, 7, 100]).to_df())


@query("edit_const", """
SELECT p_partkey,
       CASE WHEN row_number() OVER (ORDER BY p_partkey) - 1 IN (0, 5, 10) THEN 'EDITED'
            ELSE p_type END AS p_type
FROM part""")
def edit_const(spark, d):
    return (W(spark, d, "part", ["p_partkey", "p_type"], order_by="p_partkey")
            .edit(value="EDITED", columns="p_type", rows=[0, 5, 10]).to_df())


@query("edit_fn", """
SELECT p_partkey, upper(p_name) AS p_name FROM part""")
def edit_fn(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_name"]).edit(fn=F.upper, columns="p_name").to_df()


# ------------------------------------------------------------ split

@query("split_literal", """
SELECT p_partkey,
       CASE WHEN strpos(p_brand, '#') > 0 THEN substr(p_brand, 1, strpos(p_brand, '#') - 1)
            ELSE p_brand END AS p_brand_1,
       CASE WHEN strpos(p_brand, '#') > 0 THEN substr(p_brand, strpos(p_brand, '#') + 1)
            ELSE '' END AS p_brand_2
FROM part""")
def split_literal(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_brand"]).split_value("#", "p_brand").to_df()


@query("split_index", """
SELECT p_partkey,
       CASE WHEN length(p_name) > 3 THEN substr(p_name, 1, 3) ELSE p_name END AS p_name_1,
       CASE WHEN length(p_name) > 3 THEN substr(p_name, 5) ELSE '' END AS p_name_2
FROM part""")
def split_index(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_name"]).split_index(3, "p_name").to_df()


@query("split_right", """
SELECT page_id,
       CASE WHEN strpos(url, '/') > 0 THEN regexp_extract(url, '^(.*)/', 1) ELSE url END AS url_1,
       CASE WHEN strpos(url, '/') > 0 THEN regexp_extract(url, '/([^/]*)$', 1) ELSE '' END AS url_2
FROM pages""")
def split_right(spark, d):
    return W(spark, d, "pages", ["page_id", "url"]).split_right("/", "url").to_df()


@query("split_fn", """
WITH t AS (SELECT page_id, url, regexp_extract(url, '//([^/]+)', 1) AS r FROM pages)
SELECT page_id,
       CASE WHEN strpos(url, r) > 0 THEN substr(url, 1, strpos(url, r) - 1) ELSE url END AS url_1,
       CASE WHEN strpos(url, r) > 0 THEN substr(url, strpos(url, r) + length(r)) ELSE '' END AS url_2
FROM t""")
def split_fn(spark, d):
    return (W(spark, d, "pages", ["page_id", "url"])
            .split_fn(lambda c: F.regexp_extract(c, "//([^/]+)", 1), "url").to_df())


_SPLIT_ALL_W = 6


def _split_all_sql() -> str:
    cols = ",\n       ".join(f"coalesce(l[{k}], '') AS url_{k}" for k in range(1, _SPLIT_ALL_W + 1))
    return f"""
WITH t AS (SELECT page_id, string_split(url, '/') AS l FROM pages)
SELECT page_id,
       {cols}
FROM t"""


@query("split_all", _split_all_sql())
def split_all(spark, d):
    return (W(spark, d, "pages", ["page_id", "url"])
            .split_all("/", "url", width=_SPLIT_ALL_W).to_df())


@query("split_all_auto", """
SELECT page_id, replace(url, '/', '') AS url FROM pages""")
def split_all_auto(spark, d):
    # The width is discovered; the pieces are joined again so that SQL can check them
    w = W(spark, d, "pages", ["page_id", "url"]).split_all("/", "url")
    return w.merge(list(w.created), glue="", name="url").to_df()


@query("split_regex", """
SELECT event_id,
       CASE WHEN regexp_matches(props, '[0-9]+') THEN regexp_extract(props, '^(.*?)[0-9]+', 1)
            ELSE props END AS props_1,
       CASE WHEN regexp_matches(props, '[0-9]+') THEN regexp_replace(props, '^.*?[0-9]+', '')
            ELSE '' END AS props_2
FROM events""")
def split_regex(spark, d):
    return (W(spark, d, "events", ["event_id", "props"])
            .split(on=re_("[0-9]+"), columns="props").to_df())


@query("split_after", """
SELECT o_orderkey,
       CASE WHEN strpos(o_orderpriority, '-') > 0
            THEN substr(o_orderpriority, 1, strpos(o_orderpriority, '-')) ELSE o_orderpriority END
            AS o_orderpriority_1,
       CASE WHEN strpos(o_orderpriority, '-') > 0
            THEN substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) ELSE '' END
            AS o_orderpriority_2
FROM orders""")
def split_after(spark, d):
    return (W(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
            .split(after="-", columns="o_orderpriority").to_df())


@query("split_before", """
SELECT o_orderkey,
       CASE WHEN strpos(o_orderpriority, '-') > 0
            THEN substr(o_orderpriority, 1, strpos(o_orderpriority, '-') - 1) ELSE o_orderpriority END
            AS o_orderpriority_1,
       CASE WHEN strpos(o_orderpriority, '-') > 0
            THEN substr(o_orderpriority, strpos(o_orderpriority, '-')) ELSE '' END
            AS o_orderpriority_2
FROM orders""")
def split_before(spark, d):
    return (W(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
            .split(before="-", columns="o_orderpriority").to_df())


@query("split_int_after", """
SELECT o_orderkey,
       CASE WHEN length(o_orderpriority) > 1 THEN substr(o_orderpriority, 1, 2)
            ELSE o_orderpriority END AS o_orderpriority_1,
       CASE WHEN length(o_orderpriority) > 1 THEN substr(o_orderpriority, 3) ELSE '' END
            AS o_orderpriority_2
FROM orders""")
def split_int_after(spark, d):
    return (W(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
            .split(after=1, columns="o_orderpriority").to_df())


@query("split_int_before", """
SELECT o_orderkey,
       CASE WHEN length(o_orderpriority) > 1 THEN substr(o_orderpriority, 1, 1)
            ELSE o_orderpriority END AS o_orderpriority_1,
       CASE WHEN length(o_orderpriority) > 1 THEN substr(o_orderpriority, 2) ELSE '' END
            AS o_orderpriority_2
FROM orders""")
def split_int_before(spark, d):
    return (W(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
            .split(before=1, columns="o_orderpriority").to_df())


@query("split_between", """
WITH t AS (SELECT o_orderkey, o_orderpriority AS x, strpos(o_orderpriority, '-') AS p FROM orders),
     u AS (SELECT *, strpos(substr(x, p + 1), 'E') AS q FROM t)
SELECT o_orderkey,
       CASE WHEN p > 0 AND q > 1 THEN substr(x, 1, p) ELSE x END AS o_orderpriority_1,
       CASE WHEN p > 0 AND q > 1 THEN substr(x, p + q) ELSE '' END AS o_orderpriority_2
FROM u""")
def split_between(spark, d):
    return (W(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
            .split(between=("-", "E"), columns="o_orderpriority").to_df())


@query("split_list", """
WITH t AS (SELECT o_orderkey, o_orderpriority AS x, strpos(o_orderpriority, ' ') AS p FROM orders),
     u AS (SELECT o_orderkey, CASE WHEN p > 0 THEN [substr(x, 1, p - 1), substr(x, p + 1)]
                                   ELSE [x] END AS a FROM t),
     v AS (SELECT o_orderkey, flatten(list_transform(a, lambda y:
                CASE WHEN strpos(y, '-') > 0
                     THEN [substr(y, 1, strpos(y, '-') - 1), substr(y, strpos(y, '-') + 1)]
                     ELSE [y] END)) AS b FROM u)
SELECT o_orderkey, coalesce(b[1], '') AS o_orderpriority_1, coalesce(b[2], '') AS o_orderpriority_2,
       coalesce(b[3], '') AS o_orderpriority_3
FROM v""")
def split_list(spark, d):
    # A list of specs, applied in C14 order to every piece (the five
    # priorities give at most three pieces); width found by one aggregate
    return (W(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
            .split(on=["-", " "], columns="o_orderpriority").to_df())


# ---------------------------------------------------------- extract

@query("extract_char", """
SELECT event_id, props AS props_1,
       CASE WHEN length(props) > 2 THEN substr(props, 3, 1) ELSE '' END AS props_2
FROM events""")
def extract_char(spark, d):
    return W(spark, d, "events", ["event_id", "props"]).extract_index(2, "props").to_df()


@query("extract_value", """
SELECT p_partkey, p_name AS p_name_1,
       CASE WHEN strpos(p_name, 'ring') > 0 THEN 'ring' ELSE '' END AS p_name_2
FROM part""")
def extract_value(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_name"]).extract_value("ring", "p_name").to_df()


@query("extract_fn", """
SELECT p_partkey, p_brand AS p_brand_1, regexp_extract(p_brand, '[0-9]+', 0) AS p_brand_2
FROM part""")
def extract_fn(spark, d):
    return (W(spark, d, "part", ["p_partkey", "p_brand"])
            .extract_fn(lambda c: F.regexp_extract(c, "[0-9]+", 0), "p_brand").to_df())


@query("extract_regex", """
SELECT event_id, regexp_replace(props, '[0-9]+', '') AS props_1,
       regexp_extract(props, '[0-9]+', 0) AS props_2
FROM events""")
def extract_regex(spark, d):
    return (W(spark, d, "events", ["event_id", "props"])
            .extract(on=re_("[0-9]+"), columns="props").to_df())


@query("extract_remove", """
SELECT p_partkey,
       CASE WHEN strpos(p_name, 'e') > 0
            THEN substr(p_name, 1, strpos(p_name, 'e') - 1) || substr(p_name, strpos(p_name, 'e') + 1)
            ELSE p_name END AS p_name_1,
       CASE WHEN strpos(p_name, 'e') > 0 THEN 'e' ELSE '' END AS p_name_2
FROM part""")
def extract_remove(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_name"]).extract(on="e", columns="p_name").to_df()


@query("extract_int", """
SELECT p_partkey,
       CASE WHEN length(p_name) > 2 THEN substr(p_name, 1, 2) || substr(p_name, 4) ELSE p_name END
            AS p_name_1,
       CASE WHEN length(p_name) > 2 THEN substr(p_name, 3, 1) ELSE '' END AS p_name_2
FROM part""")
def extract_int(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_name"]).extract(on=2, columns="p_name").to_df()


@query("extract_range", r"""
WITH t AS (SELECT event_id, props AS x, strpos(props, '{') AS p FROM events),
     u AS (SELECT *, strpos(substr(x, p + 1), '}') AS q FROM t)
SELECT event_id,
       CASE WHEN p > 0 AND q > 1 THEN substr(x, 1, p) || substr(x, p + q) ELSE x END AS props_1,
       CASE WHEN p > 0 AND q > 1 THEN substr(x, p + 1, q - 1) ELSE '' END AS props_2
FROM u""")
def extract_range(spark, d):
    return (W(spark, d, "events", ["event_id", "props"])
            .extract(between=("{", "}"), columns="props").to_df())


_BETWEEN_VOWELS = """
WITH t AS (SELECT p_partkey, p_name AS x, regexp_extract(p_name, '^[^aeiou]*') AS a,
                  CASE WHEN regexp_matches(p_name, '[aeiou]') THEN regexp_extract(p_name, '[^aeiou]*$') ELSE '' END AS z
           FROM part),
     u AS (SELECT *, substr(x, length(a) + 1, length(x) - length(a) - length(z)) AS m FROM t)
"""


def _pieces(w: Wrangler) -> DataFrame:
    """The pieces of ``p_name`` as one cell, whatever their number in these tables."""
    df = w.to_df()
    return df.select("p_partkey", F.rtrim(F.concat_ws("|", *[c for c in df.columns if c != "p_partkey"]), F.lit("|")).alias("pieces"))


@query("split_between_all", _BETWEEN_VOWELS + """
SELECT p_partkey, a || regexp_replace(m, '[^aeiou]+', '|', 'g') || z AS pieces FROM u""")
def split_between_all(spark, d):
    # P9 all: the start, a run of vowels, has any length; the next range begins with the end
    return _pieces(W(spark, d, "part", ["p_partkey", "p_name"])
                   .split(between=(re_("[aeiou]+"), re_("[aeiou]")), max="all", columns="p_name"))


@query("extract_between_all", _BETWEEN_VOWELS + """
SELECT p_partkey, rtrim(a || regexp_replace(m, '[^aeiou]+', '', 'g') || z || '|' ||
                        array_to_string(regexp_extract_all(m, '[^aeiou]+'), '|'), '|') AS pieces FROM u""")
def extract_between_all(spark, d):
    # E6 all: the cell without its ranges, then every range
    return _pieces(W(spark, d, "part", ["p_partkey", "p_name"])
                   .extract(between=(re_("[aeiou]+"), re_("[aeiou]")), max="all", columns="p_name"))


@query("extract_all", """
WITH t AS (SELECT event_id, regexp_replace(props, '[0-9]', '', 'g') AS r,
                  regexp_extract_all(props, '[0-9]') AS m FROM events)
SELECT event_id, r AS props_1, coalesce(m[1], '') AS props_2, coalesce(m[2], '') AS props_3
FROM t""")
def extract_all(spark, d):
    # E4 all: the cell without every match, then one column per match
    return (W(spark, d, "events", ["event_id", "props"])
            .extract(on=re_("[0-9]"), max="all", columns="props").to_df())


# ------------------------------------------------------- rows/columns

@query("delete_any", """
SELECT * FROM part WHERE NOT (strpos(p_name, 'ring') > 0 OR strpos(p_type, 'ring') > 0)""")
def delete_any(spark, d):
    return (Wrangler(table(spark, d, "part"))
            .delete(pred=lambda c: F.instr(c, "ring") > 0, columns=["p_name", "p_type"]).to_df())


@query("delete_regex", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE NOT regexp_matches(o_orderpriority, 'URGENT|HIGH')""")
def delete_regex(spark, d):
    return (W(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
            .delete(columns="o_orderpriority", where="URGENT|HIGH").to_df())


@query("delete_rows", """
SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (ORDER BY event_id) - 1 NOT IN (0, 1, 2, 100, 999)""")
def delete_rows(spark, d):
    return (W(spark, d, "events", ["event_id", "event_type"], order_by="event_id")
            .delete(rows=[0, 1, 2, 100, 999]).to_df())


@query("drop_cols", """
SELECT p_partkey, p_name, p_size FROM part""")
def drop_cols(spark, d):
    return Wrangler(table(spark, d, "part")).drop(["p_brand", 3, "p_retailprice"]).to_df()


@query("merge_cols", """
SELECT p_partkey, p_name, p_brand || '|' || p_type AS p_brandp_type, p_size FROM part""")
def merge_cols(spark, d):
    return (W(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
            .merge(["p_type", "p_brand"], glue="|").to_df())


@query("merge_apart", """
SELECT p_partkey, p_brand, p_size, p_name || '/' || p_type AS p_namep_type FROM part""")
def merge_apart(spark, d):
    return (W(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
            .merge(["p_name", "p_type"], glue="/", placement="auto").to_df())


@query("merge_all", """
SELECT CAST(n_nationkey AS VARCHAR) || ',' || n_name || ',' || CAST(n_regionkey AS VARCHAR)
       AS n_nationkeyn_namen_regionkey
FROM nation""")
def merge_all(spark, d):
    return Wrangler(table(spark, d, "nation")).merge_all(",").to_df()


# -------------------------------------------------------------- fill

def _events_blanked(spark, d, cols=("event_id", "event_type")):
    w = W(spark, d, "events", list(cols), order_by="event_id")
    return w.edit(fn=lambda c: F.when(c == "error", F.lit("")).otherwise(c), columns="event_type")


@query("fill_down", """
WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS v FROM events)
SELECT event_id,
       coalesce(last_value(nullif(v, '') IGNORE NULLS) OVER (ORDER BY event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v) AS event_type
FROM t""")
def fill_down(spark, d):
    return _events_blanked(spark, d).fill_down("event_type").to_df()


@query("fill_up", """
WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS v FROM events)
SELECT event_id,
       coalesce(first_value(nullif(v, '') IGNORE NULLS) OVER (ORDER BY event_id
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), v) AS event_type
FROM t""")
def fill_up(spark, d):
    return _events_blanked(spark, d).fill_up("event_type").to_df()


@query("fill_value", """
SELECT event_id,
       coalesce(last_value(nullif(event_type, 'error') IGNORE NULLS) OVER (ORDER BY event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), event_type) AS event_type
FROM events""")
def fill_value(spark, d):
    return (W(spark, d, "events", ["event_id", "event_type"], order_by="event_id")
            .fill_down("event_type", blank="error").to_df())


@query("fill_pred", """
SELECT event_id,
       coalesce(last_value(CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE event_type END
                IGNORE NULLS) OVER (ORDER BY event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), event_type) AS event_type
FROM events""")
def fill_pred(spark, d):
    return (W(spark, d, "events", ["event_id", "event_type"], order_by="event_id")
            .fill_down("event_type", blank=lambda c: c.isin("error", "view")).to_df())


def _part_blanked(spark, d, col):
    w = W(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    return w.edit(fn=lambda c: F.when(F.col("p_size") < 10, F.lit("")).otherwise(c), columns=col)


@query("fill_left", """
SELECT p_partkey, p_name, p_brand,
       CASE WHEN p_size < 10 THEN p_brand ELSE p_type END AS p_type, p_size
FROM part""")
def fill_left(spark, d):
    return _part_blanked(spark, d, "p_type").fill_left(["p_name", "p_brand", "p_type"]).to_df()


@query("fill_right", """
SELECT p_partkey, CASE WHEN p_size < 10 THEN p_brand ELSE p_name END AS p_name, p_brand,
       p_type, p_size
FROM part""")
def fill_right(spark, d):
    return _part_blanked(spark, d, "p_name").fill_right(["p_name", "p_brand"]).to_df()


@query("fill_column", """
SELECT p_partkey, p_name, p_brand, CASE WHEN p_size < 10 THEN p_brand ELSE p_type END AS p_type,
       p_size
FROM part""")
def fill_column(spark, d):
    return _part_blanked(spark, d, "p_type").fill_column("p_brand", "p_type").to_df()


@query("fill_row", """
WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS v,
                  row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events),
     s AS (SELECT v AS sv FROM t WHERE rn = 3)
SELECT event_id,
       CASE WHEN rn BETWEEN 0 AND 40 AND v = '' AND sv IS NOT NULL THEN sv ELSE v END AS event_type
FROM t LEFT JOIN s ON true""")
def fill_row(spark, d):
    return _events_blanked(spark, d).fill_row(3, list(range(41)), columns="event_type").to_df()


@query("fill_down_part", """
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '' ELSE text END AS v
           FROM conversations)
SELECT conv_id, turn,
       coalesce(last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v) AS text
FROM t""")
def fill_down_part(spark, d):
    w = W(spark, d, "conversations", ["conv_id", "turn", "role", "text"],
          order_by=["conv_id", "turn"], part="conv_id")
    w = w.edit(fn=lambda c: F.when(F.col("role") == "assistant", F.lit("")).otherwise(c),
               columns="text")
    return w.drop("role").fill_down("text").to_df(with_part=False)


# -------------------------------------------------------- order / header

@query("row_id", """
SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events""")
def row_id(spark, d):
    return W(spark, d, "events", ["event_id"], order_by="event_id").with_row_id().to_df()


@query("row_id_text_key", """
SELECT c_custkey, row_number() OVER (ORDER BY c_name) - 1 AS row_id FROM customer""")
def row_id_text_key(spark, d):
    return W(spark, d, "customer", ["c_custkey"], order_by="c_name").with_row_id().to_df()


@query("promote_names", """
SELECT p_partkey AS key, p_name AS name, p_brand FROM part""")
def promote_names(spark, d):
    # H1: a shorter list names the first columns and keeps the rest
    return W(spark, d, "part", ["p_partkey", "p_name", "p_brand"]).promote(
        names=["key", "name"]).to_df()


@query("promote_row", """
SELECT r_regionkey AS "0", r_name AS "AFRICA" FROM region WHERE r_regionkey <> 0""")
def promote_row(spark, d):
    return W(spark, d, "region", ["r_regionkey", "r_name"], order_by="r_regionkey").promote(
        row=0).to_df()


@query("demote", """
WITH r AS (SELECT CAST(r_regionkey AS VARCHAR) AS c0, r_name AS c1,
                  row_number() OVER (ORDER BY r_regionkey) - 1 AS rn FROM region)
SELECT c0, c1, CASE WHEN rn < 2 THEN rn ELSE rn + 1 END AS row_id FROM r
UNION ALL SELECT 'r_regionkey', 'r_name', 2""")
def demote(spark, d):
    return (W(spark, d, "region", ["r_regionkey", "r_name"], order_by="r_regionkey")
            .demote(2).with_row_id().to_df())


# ---------------------------------------------------------- reshape

def _wrap_n_sql() -> str:
    cells = []
    for j in range(3):
        cells.append(f"coalesce(max(CASE WHEN rn % 3 = {j} THEN event_type END), '') AS c{2 * j}")
        cells.append(f"coalesce(max(CASE WHEN rn % 3 = {j} THEN CAST(user_id AS VARCHAR) END), '')"
                     f" AS c{2 * j + 1}")
    return ("WITH t AS (SELECT event_type, user_id, row_number() OVER (ORDER BY event_id) - 1 AS rn "
            "FROM events)\nSELECT " + ",\n       ".join(cells) + "\nFROM t GROUP BY rn // 3")


@query("wrap_n", _wrap_n_sql())
def wrap_n(spark, d):
    return (W(spark, d, "events", ["event_type", "user_id"], order_by="event_id")
            .wrap_rows(3).to_df())


@query("wrap_short", """
SELECT CAST(n_nationkey AS VARCHAR) AS c0, CAST(n_regionkey AS VARCHAR) AS c1 FROM nation
UNION ALL SELECT n_name, '' FROM nation""")
def wrap_short(spark, d):
    return W(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"],
             order_by="n_nationkey").wrap(2).to_df()


_WRAP_RE, _WRAP_W = "error|purchase", 40


def _wrap_regex_sql() -> str:
    cells = ",\n       ".join(f"coalesce(max(CASE WHEN pos = {j} THEN v END), '') AS c{j}"
                              for j in range(_WRAP_W))
    return f"""
WITH t AS (SELECT event_type AS v, row_number() OVER (ORDER BY event_id) - 1 AS rn,
                  regexp_matches(event_type, '{_WRAP_RE}') AS hit FROM events),
     g AS (SELECT v, rn,
                  sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (ORDER BY rn
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp,
                  rn - coalesce(max(CASE WHEN hit THEN rn END) OVER (ORDER BY rn
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS pos
           FROM t)
SELECT {cells}
FROM g GROUP BY grp"""


@query("wrap_regex", _wrap_regex_sql())
def wrap_regex(spark, d):
    return (W(spark, d, "events", ["event_type"], order_by="event_id")
            .wrap(where=_WRAP_RE, width=_WRAP_W).to_df())


@query("wrap_column", """
WITH cells AS (
  SELECT event_id * 2 AS i, event_type AS v FROM events
  UNION ALL SELECT event_id * 2 + 1, CAST(user_id AS VARCHAR) FROM events),
marked AS (SELECT i, v, sum(CASE WHEN v IN ('click', 'view') THEN 1 ELSE 0 END) OVER (ORDER BY i) AS g FROM cells)
SELECT string_agg(v, '|' ORDER BY i) AS cells FROM marked GROUP BY g""")
def wrap_column(spark, d):
    # A predicate on the cells of two columns, read row by row; only these columns stay
    w = (W(spark, d, "events", ["event_type", "user_id", "props"], order_by="event_id")
         .wrap(where=lambda c: c.isin("click", "view"), columns=["event_type", "user_id"], by="row", as_array=True))
    return w.to_df().select(F.array_join("cells", "|").alias("cells"))


@query("fold", """
SELECT p_partkey, p_size, 'p_name' AS key, p_name AS value FROM part
UNION ALL SELECT p_partkey, p_size, 'p_brand', p_brand FROM part
UNION ALL SELECT p_partkey, p_size, 'p_type', p_type FROM part""")
def fold(spark, d):
    return (W(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
            .fold(["p_name", "p_brand", "p_type"]).to_df())


@query("fold_rows", """
SELECT n_nationkey, 'NATION_0' AS key, n_name AS value FROM nation WHERE n_nationkey <> 0
UNION ALL SELECT n_nationkey, '0', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey <> 0""")
def fold_rows(spark, d):
    return (W(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"], order_by="n_nationkey")
            .fold(["n_name", "n_regionkey"], rows=[0]).to_df())


@query("fold_where", """
SELECT n.n_nationkey, k1.n_name AS key_1, k2.n_name AS key_2, n.n_name AS value
FROM nation n, nation k1, nation k2
WHERE k1.n_nationkey = 1 AND k2.n_nationkey = 12 AND n.n_nationkey NOT IN (1, 12)
UNION ALL SELECT n.n_nationkey, CAST(k1.n_regionkey AS VARCHAR), CAST(k2.n_regionkey AS VARCHAR), CAST(n.n_regionkey AS VARCHAR)
FROM nation n, nation k1, nation k2
WHERE k1.n_nationkey = 1 AND k2.n_nationkey = 12 AND n.n_nationkey NOT IN (1, 12)""")
def fold_where(spark, d):
    # Two key rows chosen by a predicate on the first folded column
    return (W(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"], order_by="n_nationkey")
            .fold(["n_name", "n_regionkey"], where=lambda c: c.isin("NATION_1", "NATION_12")).to_df())


@query("fold_part", """
WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
k AS (SELECT conv_id, role, text FROM r WHERE n = 1)
SELECT r.turn, k.role AS key, r.role AS value, r.conv_id AS _part FROM r JOIN k USING (conv_id) WHERE n > 1
UNION ALL SELECT r.turn, k.text, r.text, r.conv_id FROM r JOIN k USING (conv_id) WHERE n > 1""")
def fold_part(spark, d):
    # W5 per partition: every conversation's first row gives its own keys
    return (W(spark, d, "conversations", ["turn", "role", "text"], order_by="turn", part="conv_id")
            .fold(["role", "text"], rows=[0]).to_df())


@query("unfold_any_value", """
SELECT l_linestatus, coalesce(max(o) FILTER (WHERE k = 'a.1'), '') AS "a.1", coalesce(max(o) FILTER (WHERE k = 'a.2'), '') AS "a.2",
       coalesce(max(o) FILTER (WHERE k IS NULL), '') AS "null", coalesce(max(o) FILTER (WHERE k = 'A.1'), '') AS "A.1"
FROM (SELECT l_linestatus, CASE WHEN l_linenumber < 3 THEN 'a.' || l_linenumber WHEN l_linenumber = 3 THEN 'A.1' END AS k,
             '1' AS o FROM lineitem) GROUP BY l_linestatus""")
def unfold_any_value(spark, d):
    n = F.col("l_linenumber")
    key = F.when(n < 3, F.concat(F.lit("a."), n.cast("string"))).when(n == 3, F.lit("A.1"))
    li = table(spark, d, "lineitem", ["l_linestatus", "l_linenumber"]).select("l_linestatus", key.alias("k"), F.lit("1").alias("o"))
    # two headers differ by case only: no table with both is written or read without this setting
    spark.conf.set("spark.sql.caseSensitive", "true")
    return Wrangler(li).unfold("k", "o").to_df()


@query("row_id_hot", """
SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) - 1 AS row_id FROM events""")
def row_id_hot(spark, d):
    # a first key of five values, each with a fifth of all rows
    return W(spark, d, "events", ["event_id"], order_by=["event_type", "event_id"]).with_row_id().to_df()


@query("delete_rows_far", """
SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (ORDER BY event_type, event_id) - 1 NOT IN (0, 7, 999)""")
def delete_rows_far(spark, d):
    return (W(spark, d, "events", ["event_id", "event_type"], order_by=["event_type", "event_id"])
            .delete(rows=[999, 0, 7]).delete(rows=[]).to_df())


_DOUBLED = "|".join(c * 2 for c in "abcdefghijklmnopqrstuvwxyz")


@query("cut_backref", f"""
SELECT p_partkey, regexp_replace(p_type, '{_DOUBLED}', '') AS p_type FROM part""")
def cut_backref(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_type"]).cut_regex(r"([a-z])\1", "p_type").to_df()


@query("split_after_all", """
SELECT event_id, rtrim(regexp_replace(props, '([0-9]+)', '\\1|', 'g'), '|') AS props FROM events""")
def split_after_all(spark, d):
    w = W(spark, d, "events", ["event_id", "props"]).split(after=re_("[0-9]{1,9}"), max="all", columns="props")
    return _joined(w, "props")


@query("split_before_all", """
SELECT event_id, ltrim(regexp_replace(props, '([0-9]+)', '|\\1', 'g'), '|') AS props FROM events""")
def split_before_all(spark, d):
    w = W(spark, d, "events", ["event_id", "props"]).split(before=re_("[0-9]+"), max="all", columns="props")
    return _joined(w, "props")


def _joined(w: Wrangler, name: str) -> DataFrame:
    """Pieces joined again by a mark, padding dropped, so that SQL can check them."""
    return w.merge(list(w.created), glue="|", name=name).to_df().withColumn(name, F.rtrim(F.col(name), F.lit("|")))


@query("cut_before_inclusive", """
SELECT c_custkey, CASE WHEN length(c_name) >= 18 THEN substr(c_name, 19) ELSE c_name END AS c_name FROM customer""")
def cut_before_inclusive(spark, d):
    return W(spark, d, "customer", ["c_custkey", "c_name"]).cut_before(18, "c_name", inclusive=True).to_df()


@query("cut_after_regex", """
SELECT event_id, CASE WHEN regexp_matches(props, '[0-9]+') THEN regexp_extract(props, '^.*?[0-9]+') ELSE props END AS props FROM events""")
def cut_after_regex(spark, d):
    return W(spark, d, "events", ["event_id", "props"]).cut(after=re_("[0-9]+"), columns="props").to_df()


@query("cut_before_regex", """
SELECT event_id, regexp_replace(props, '^[^0-9]*([0-9])', '\\1') AS props FROM events""")
def cut_before_regex(spark, d):
    return W(spark, d, "events", ["event_id", "props"]).cut(before=re_("[0-9]+"), columns="props").to_df()


@query("cut_on_ints", """
SELECT p_partkey, CASE WHEN length(p_type) >= 5 THEN substr(p_type, 1, 1) || substr(p_type, 6) ELSE p_type END AS p_type FROM part""")
def cut_on_ints(spark, d):
    # C12 with positions: from character 1, four characters
    return W(spark, d, "part", ["p_partkey", "p_type"]).cut(on=(1, 3), columns="p_type").to_df()


@query("cut_between_all", """
SELECT event_id, regexp_replace(props, ':[^,]*,', ':,', 'g') AS props FROM events""")
def cut_between_all(spark, d):
    return (W(spark, d, "events", ["event_id", "props"])
            .cut(between=(re_(":"), ","), max="all", columns="props").to_df())


@query("delete_regex_rows", """
SELECT event_id, event_type FROM events
QUALIFY NOT (regexp_matches(event_type, 'c') AND row_number() OVER (ORDER BY event_id) - 1 IN (0, 1, 2, 3, 4, 5, 6, 7))""")
def delete_regex_rows(spark, d):
    return (W(spark, d, "events", ["event_id", "event_type"], order_by="event_id")
            .delete(where="c", columns="event_type", rows=list(range(8))).to_df())


_BLANKS = """SELECT event_id, CASE WHEN event_type = 'view' THEN 'n/a' ELSE event_type END AS a,
  CASE WHEN event_type = 'click' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS b FROM events"""


def _blanks(spark, d, **kw) -> Wrangler:
    ev = table(spark, d, "events", ["event_id", "event_type", "user_id"])
    t = F.col("event_type")
    return Wrangler(ev.select("event_id", F.when(t == "view", F.lit("n/a")).otherwise(t).alias("a"),
                              F.when(t == "click", F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("b")), **kw)


@query("fill_left_value", f"""
SELECT event_id, a, CASE WHEN b = 'n/a' THEN a ELSE b END AS b FROM ({_BLANKS})""")
def fill_left_value(spark, d):
    return _blanks(spark, d).fill_left(["a", "b"], blank="n/a").to_df()


@query("fill_right_pred", f"""
SELECT event_id, CASE WHEN length(a) = 3 THEN b ELSE a END AS a, b FROM ({_BLANKS})""")
def fill_right_pred(spark, d):
    return _blanks(spark, d).fill_right(["a", "b"], blank=lambda c: c == "n/a").to_df()


@query("fill_column_value", f"""
SELECT event_id, a, CASE WHEN b = 'n/a' THEN a ELSE b END AS b FROM ({_BLANKS})""")
def fill_column_value(spark, d):
    return _blanks(spark, d)["b"].fill_column("a", blank="n/a").to_df()


@query("fill_row_part", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS t, user_id,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
SELECT r.event_id, CASE WHEN r.n = 2 AND r.t = '' AND s.t IS NOT NULL THEN s.t ELSE r.t END AS t, r.user_id AS _part
FROM r LEFT JOIN (SELECT user_id, t FROM r WHERE n = 1) s USING (user_id)""")
def fill_row_part(spark, d):
    ev = table(spark, d, "events", ["event_id", "event_type", "user_id"])
    t = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("event_type"))
    w = Wrangler(ev.select("event_id", t.alias("t"), "user_id"), order_by="event_id", part="user_id").drop("user_id")
    return w.fill_row(1, 2, columns="t").to_df()


@query("demote_part", """
SELECT CAST(event_id AS VARCHAR) AS c0, event_type AS c1, user_id AS _part FROM events
UNION ALL SELECT DISTINCT 'event_id', 'event_type', user_id FROM events""")
def demote_part(spark, d):
    return (W(spark, d, "events", ["event_id", "event_type"], order_by="event_id", part="user_id").demote(0).to_df())


@query("translate_cols_right", """
SELECT p_partkey, p_name, '' AS blank0, '' AS blank1 FROM part""")
def translate_cols_right(spark, d):
    return W(spark, d, "part", ["p_partkey", "p_name"]).translate_right(2).to_df()


@query("translate_rows_down", """
SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region UNION ALL SELECT '', '' UNION ALL SELECT '', ''""")
def translate_rows_down(spark, d):
    return W(spark, d, "region", ["r_regionkey", "r_name"], order_by="r_regionkey").translate_down(2).to_df()


_UNFOLD_VALUES = ["click", "error", "purchase", "signup", "view"]


def _unfold_sql() -> str:
    cells = ",\n       ".join(
        f"coalesce(arg_min(props, event_id) FILTER (WHERE event_type = '{v}'), '') AS {v}"
        for v in _UNFOLD_VALUES)
    return f"SELECT user_id,\n       {cells}\nFROM events GROUP BY user_id"


@query("unfold", _unfold_sql())
def unfold(spark, d):
    return (W(spark, d, "events", ["user_id", "event_type", "props"], order_by="event_id")
            .unfold("event_type", "props").to_df())


def _unfold_wide_sql() -> str:
    cells = ",\n       ".join(f"coalesce(arg_min(l_returnflag, k) FILTER (WHERE b = {v}), '') AS \"{v}\"" for v in range(500))
    return f"""
WITH t AS (SELECT l_suppkey, l_returnflag, l_partkey % 500 AS b,
                  l_orderkey * 1000 + l_linenumber * 10 + ascii(l_returnflag) % 10 AS k FROM lineitem)
SELECT l_suppkey,
       {cells}
FROM t GROUP BY l_suppkey"""


@query("unfold_wide", _unfold_wide_sql())
def unfold_wide(spark, d):
    # 500 values: each cell is placed once, not tried for every value
    k = (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10 + F.ascii("l_returnflag") % 10).alias("k")
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 500).alias("b"), "l_returnflag", k)
    w = Wrangler(li, order_by="k").drop("k")
    return w.unfold("b", "l_returnflag", values=list(range(500))).to_df()


@query("transpose", """
WITH r AS (SELECT CAST(r_regionkey AS VARCHAR) AS a, r_name AS b,
                  row_number() OVER (ORDER BY r_regionkey) - 1 AS rn FROM region)
SELECT max(CASE WHEN rn = 0 THEN a END) AS c0, max(CASE WHEN rn = 1 THEN a END) AS c1,
       max(CASE WHEN rn = 2 THEN a END) AS c2, max(CASE WHEN rn = 3 THEN a END) AS c3,
       max(CASE WHEN rn = 4 THEN a END) AS c4 FROM r
UNION ALL
SELECT max(CASE WHEN rn = 0 THEN b END), max(CASE WHEN rn = 1 THEN b END),
       max(CASE WHEN rn = 2 THEN b END), max(CASE WHEN rn = 3 THEN b END),
       max(CASE WHEN rn = 4 THEN b END) FROM r""")
def transpose(spark, d):
    return W(spark, d, "region", ["r_regionkey", "r_name"], order_by="r_regionkey").transpose().to_df()


@query("translate_cols", """
SELECT '' AS blank0, '' AS blank1, r_regionkey, r_name FROM region""")
def translate_cols(spark, d):
    return W(spark, d, "region", ["r_regionkey", "r_name"]).translate_left(2).to_df()


@query("translate_rows", """
SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region
UNION ALL SELECT '', '' UNION ALL SELECT '', ''""")
def translate_rows(spark, d):
    return (W(spark, d, "region", ["r_regionkey", "r_name"], order_by="r_regionkey")
            .translate_up(2).to_df())


@query("translate_column", """
WITH t AS (SELECT CAST(event_id AS VARCHAR) AS e, event_type AS v,
                  row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events)
SELECT coalesce(a.e, '') AS event_id, coalesce(b.v, '') AS event_type
FROM (SELECT rn, e FROM t) a FULL OUTER JOIN (SELECT rn + 1 AS rn, v FROM t) b ON a.rn = b.rn""")
def translate_column(spark, d):
    return (W(spark, d, "events", ["event_id", "event_type"], order_by="event_id")
            .translate("event_type", "down", 1).to_df())


@query("translate_column_up", """
WITH t AS (SELECT CAST(event_id AS VARCHAR) AS e, event_type AS v,
                  row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events)
SELECT a.e AS event_id, coalesce(b.v, '') AS event_type
FROM (SELECT rn, e FROM t) a LEFT JOIN (SELECT rn - 2 AS rn, v FROM t) b ON a.rn = b.rn""")
def translate_column_up(spark, d):
    return (W(spark, d, "events", ["event_id", "event_type"], order_by="event_id")
            .translate("event_type", "up", 2).to_df())


# ------------------------------------------------------- partitions (M1-M4)

@query("partition_counts", """
SELECT lang AS _part, count(*) AS n FROM documents GROUP BY lang""")
def partition_counts(spark, d):
    w = W(spark, d, "documents", ["doc_id", "lang"]).partition(column="lang")
    return w.df.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))


@query("union_merge", """
SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name, '' AS c2 FROM region
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR) FROM nation""")
def union_merge(spark, d):
    a = W(spark, d, "region", ["r_regionkey", "r_name"], order_by="r_regionkey")
    b = W(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"], order_by="n_nationkey")
    return a.union(b).to_df()


@query("merge_selected", """
SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('click', 'view')""")
def merge_selected(spark, d):
    w = W(spark, d, "events", ["event_id", "event_type", "user_id"]).partition(column="event_type")
    return w.merge_parts(["click", "view"]).to_df()


# -------------------------------------------------------------- jobs

_DOC_ADAPTER = "The "  # the read-clipping job re-aimed at prose


def _adapter_sql(col: str, adapter: str) -> str:
    parts = [f"substr({col}, {i + 1}, 1) IN ('{a}', 'N')" for i, a in enumerate(adapter)]
    return f"(length({col}) >= {len(adapter)} AND " + " AND ".join(parts) + ")"


@query("job_clip", f"""
SELECT doc_id, CASE WHEN length(text) > 13 THEN substr(text, 14) ELSE text END AS text
FROM documents WHERE NOT {_adapter_sql('text', _DOC_ADAPTER)}""")
def job_clip(spark, d):
    w = W(spark, d, "documents", ["doc_id", "text"])
    return jobs.clip_reads(w, "text", adapter=_DOC_ADAPTER).to_df()


@query("job_barcode", f"""
SELECT substr(text, 5, 4) AS _part, count(*) AS n
FROM documents WHERE NOT {_adapter_sql('text', _DOC_ADAPTER)} GROUP BY 1""")
def job_barcode(spark, d):
    w = W(spark, d, "documents", ["doc_id", "text"])
    return jobs.barcode_counts(w, "text", adapter=_DOC_ADAPTER)


_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
            "l_linestatus", "l_shipdate"]


@query("job_clean", """
SELECT CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey,
       CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag, l_linestatus
FROM lineitem WHERE NOT regexp_matches(CAST(l_partkey AS VARCHAR), '1[0-8]')""")
def job_clean(spark, d):
    li = table(spark, d, "lineitem", _LI_COLS)
    data = li.select(
        F.concat_ws(",", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.concat(F.lit('"'), F.col("l_returnflag"), F.lit('"')), F.col("l_linestatus"),
                    F.date_format("l_shipdate", "yyyy-MM-dd")).alias("line"),
        F.lit(1).alias("k"))
    header = spark.range(1).select(F.lit(",".join(_LI_COLS)).alias("line"), F.lit(0).alias("k"))
    w = lines_from(header.unionByName(data), "line", order_by="k", cols=",", width=7)
    return jobs.clean_photos(w).to_df()


def _scrub_sql() -> str:
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    sel = []
    for i, c in enumerate(cols):
        y = f"regexp_replace(regexp_replace(CAST({c} AS VARCHAR), '1', ''), '3', '')"
        sel.append(f"CASE WHEN strpos({y}, '5') > 0 THEN substr({y}, 1, strpos({y}, '5') - 1) "
                   f"ELSE {y} END AS c{i}_1")
        sel.append(f"CASE WHEN strpos({y}, '5') > 0 THEN substr({y}, strpos({y}, '5') + 1) "
                   f"ELSE '' END AS c{i}_2")
    return "SELECT " + ",\n       ".join(sel) + "\nFROM lineitem"


@query("job_scrub", _scrub_sql())
def job_scrub(spark, d):
    li = table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    lines = li.select(F.concat_ws(",", *[F.col(c).cast("string") for c in
                                         ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]])
                      .alias("line"))
    w = lines_from(lines, "line", order_by=None, cols=",", width=4)
    return jobs.scrub_digits(w).to_df()


@query("job_latlong", """
WITH t AS (SELECT CAST(event_id AS VARCHAR) AS id, printf('%.2f', value) || '"' AS lat,
                  CAST(user_id AS VARCHAR) || '.' || CAST(event_id % 100 AS VARCHAR) || '"' AS lon,
                  strftime(ts, '%Y-%m-%d') AS dt, event_type || '"' AS com FROM events),
     a AS (SELECT *, CASE WHEN strpos(lat, '.') > 0 THEN substr(lat, 1, strpos(lat, '.')) ELSE lat END
                     AS lat1,
                  CASE WHEN strpos(lon, '.') > 0 THEN substr(lon, 1, strpos(lon, '.')) ELSE lon END
                     AS lon1 FROM t)
SELECT id AS "ID",
       CASE WHEN strpos(lat1, '.') > 0 THEN substr(lat1, 1, strpos(lat1, '.') - 1) || substr(lat1, strpos(lat1, '.') + 1)
            ELSE lat1 END AS "LATITUDE",
       CASE WHEN strpos(lon1, '.') > 0 THEN substr(lon1, 1, strpos(lon1, '.') - 1) || substr(lon1, strpos(lon1, '.') + 1)
            ELSE lon1 END AS "LONGITUDE",
       dt AS "DATETIME_1", com AS "COMMENT"
FROM a""")
def job_latlong(spark, d):
    ev = table(spark, d, "events", ["event_id", "value", "user_id", "ts", "event_type"])
    line = F.concat(
        F.col("event_id").cast("string"), F.lit(',"'), F.format_string("%.2f", F.col("value")),
        F.lit('","'), F.col("user_id").cast("string"), F.lit("."),
        (F.col("event_id") % 100).cast("string"), F.lit('",'),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(',"'), F.col("event_type"), F.lit('"'))
    w = lines_from(ev.select(line.alias("line"), "event_id"), "line", order_by="event_id",
                   cols=",", width=5)
    return jobs.clean_latlong(w).to_df()


@query("job_force", """
SELECT regexp_replace(CAST(p_partkey AS VARCHAR), '1', '') AS p_partkey,
       regexp_replace(p_name, '1', '') AS p_name, regexp_replace(p_brand, '1', '') AS p_brand,
       count(*) OVER () AS forced_1, count(*) OVER () AS forced_3, count(*) OVER () AS forced_4
FROM part""")
def job_force(spark, d):
    w = W(spark, d, "part", ["p_partkey", "p_name", "p_brand"])
    first, counts = jobs.incremental_force(w)
    return first.to_df().select("*", *[F.lit(n).cast("long").alias(f"forced_{i}") for i, n in zip((1, 3, 4), counts)])


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
