"""Small helpers shared by the operators: column picking, shared folders, byte chunks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default vocabulary file of the tokenizing operators; always a parameter.
WORD_BPE = "word_bpe_49k.json"


def col(name: str) -> Column:
    """Column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under the operator's own names (``pick(df, id="doc_id")``),
    so that further columns of the input can never clash with working columns."""
    return df.select(*[col(src).alias(dst) for dst, src in wanted.items()])


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name, i = base, 0
    while name.lower() in taken:
        i += 1
        name = f"{base}_{i}"
    return name


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share. Only a
    session without that setting (tests) gets a temporary folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sheaf-llm-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage
    and keeps the rows when executors are lost."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def with_row_key(d: DataFrame) -> DataFrame:
    """Adds ``h`` (bigint), so that ``(id, h)`` is another for every row of ``d``: the row's number
    in a stored copy of ``d``, or 0 in all rows if no id repeats, which needs no copy."""
    repeated = d.groupBy("id").count().where("count > 1").limit(1).count()
    if repeated:
        return stored(d.withColumn("h", F.monotonically_increasing_id()))
    return d.withColumn("h", F.lit(0).cast("long"))


def mounted(folder: str) -> str:
    """The local path of a shared folder that workers mount (file: paths only)."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"{folder}: workers map the model into memory, so its folder has to be a "
                         "shared mount (file:///...); give one as a parameter")
    return folder


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Place of a vocabulary file: a path as given, or a file name of the public set."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_TOKENIZERS: dict = {}


def load_tokenizer(name: str = WORD_BPE):
    """The tokenizer, loaded once per worker process, without truncation and padding."""
    if name not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_path(name))
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[name] = t
    return _TOKENIZERS[name]


WHITE = b" \t\n\x0b\x0c\r"


def byte_chunks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut only at ASCII white space, so that
    the words of a very long text are never all in memory as objects at once."""
    at, end = 0, len(data)
    while end - at > size:
        cut = max(data.rfind(bytes([w]), at + 1, at + size) for w in WHITE)
        if cut <= at:  # one word longer than a chunk: take all of it
            cuts = [c for c in (data.find(bytes([w]), at + size) for w in WHITE) if c >= 0]
            cut = min(cuts) if cuts else end
        yield data[at:cut]
        at = cut
    if at < end or end == 0:
        yield data[at:]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the workers of the session's application (once), for
    clusters on which it is not installed."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    where = Path(tempfile.mkdtemp(prefix="sheaf-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(where))
    _SHIPPED.add(app)
