"""The reference's sample jobs (J1-J6), written with the verbs.

Each job takes a ``Wrangler`` (so it runs on any text source or table) and
returns one; nothing here collects data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Wrangler

# Fixed values of the read-clipping job: the adapter prefix and the wildcard
# base, the number of leading characters trimmed, and the barcode position.
ADAPTER = "AGAT"
WILDCARD = "N"
CLIP = 13
BARCODE_START, BARCODE_LEN = 4, 4


def adapter_match(c: Column, adapter: str = ADAPTER, wildcard: str = WILDCARD,
                  mode: str = "all") -> Column:
    """Read starts with the adapter: each of its first ``len(adapter)`` characters
    equals the adapter's or the wildcard (``mode='all'``; ``'any'`` = at least
    one position agrees). Reads shorter than the adapter never match."""
    checks = [F.substr(c, F.lit(i + 1), F.lit(1)).isin(a, wildcard)
              for i, a in enumerate(adapter)]
    comb = reduce((lambda x, y: x & y) if mode == "all" else (lambda x, y: x | y), checks)
    return (F.length(c) >= len(adapter)) & comb


def clip_reads(w: Wrangler, column="seq", adapter: str = ADAPTER, wildcard: str = WILDCARD,
               clip: int = CLIP, inclusive: bool = False) -> Wrangler:
    """Delete reads starting with the adapter, then drop the first ``clip``
    characters of the rest."""
    w = w.delete(pred=lambda c: adapter_match(c, adapter, wildcard), columns=column)
    return w.cut_before(clip, columns=column, inclusive=inclusive)


def barcode_counts(w: Wrangler, column="seq", adapter: str = ADAPTER, wildcard: str = WILDCARD,
                   clip: int = CLIP, mode: str = "all", keep_matches: bool = False):
    """Partition reads by the barcode ``seq[4:8]``, clip and trim each
    partition, count rows per partition -> DataFrame(_part, n).

    ``keep_matches=False`` deletes adapter reads (the C++ rule); ``True`` keeps
    only them (the raw-RDD variant), with ``mode`` choosing all/any positions.
    """
    (name,) = w.resolve(column)
    w = w.partition(lambda c: F.substr(c, F.lit(BARCODE_START + 1), F.lit(BARCODE_LEN)), name)
    hit = adapter_match(w.text(name), adapter, wildcard, mode)
    df = w.df.filter(F.coalesce(hit, F.lit(False)) if keep_matches
                     else ~F.coalesce(hit, F.lit(False)))
    w = w._with(df=df).cut_before(clip, columns=name, inclusive=True)
    return w.df.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))


def clean_photos(w: Wrangler) -> Wrangler:
    """Promote row 0, strip every double quote, drop column 0 and then
    column 5, delete rows whose column 0 contains a match of ``1[0-8]``."""
    w = w.promote(row=0).cut_all('"').drop(0).drop(5)
    return w.delete(columns=0, where="1[0-8]")


def scrub_digits(w: Wrangler) -> Wrangler:
    """Cut the first '"', '1' and '3' (regex), split every column at the first '5'."""
    return w.cut_regex('"').cut_regex("1").cut_regex("3").split_value("5")


# Fixed values of the lat/long job: its header.
LATLONG_NAMES = ["ID", "LATITUDE", "LONGITUDE", "DATETIME", "COMMENT"]


def clean_latlong(w: Wrangler) -> Wrangler:
    """Cut the first quote, name the columns, keep whole degrees of
    latitude/longitude, split the timestamp at the space and drop the time."""
    w = w.cut_regex('"').promote(names=LATLONG_NAMES)
    w = w.cut(after=".", on=".", columns=["LATITUDE", "LONGITUDE"])
    w = w.split_value(" ", columns="DATETIME")
    return w.drop("DATETIME_2")


def incremental_force(w: Wrangler) -> tuple[Wrangler, list[int]]:
    """Four cut steps forced after the 1st, 3rd and 4th; the first step is
    persisted so the later forces do not re-read the source, and released at the
    end. Returns the first step's table (what the job writes) and the three counts."""
    first = w.cut_regex("1").persist()
    try:
        counts = [first.force()]
        second = first.cut_regex("2").cut_regex("3")
        counts.append(second.force())
        counts.append(second.cut_regex("4").force())
    finally:
        first.unpersist()
    return first, counts
