"""What the operators share: tables written to the cluster's shared folder, and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.shared import shared_folder as shared_folder

_SENT: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
#: Rows and bytes of an Arrow batch, at most and about; one longer row makes a batch by itself.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


def _tables(spark: SparkSession) -> list[str]:
    """Paths that operators wrote to in this application."""
    return _WRITTEN.setdefault(spark.sparkContext.applicationId, [])


def tracked(spark: SparkSession, path: str) -> str:
    """A path that :func:`clear` is to remove."""
    _tables(spark).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe when executors are lost.

    The table stays until :func:`clear`, since results that Spark computes later read it.
    """
    spark = df.sparkSession
    path = tracked(spark, new_path(spark, name))
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._sparkloom_path = path
    return found


def forget(df: DataFrame) -> None:
    """Removes a table of :func:`written` that no later result reads."""
    _remove(df.sparkSession, df._sparkloom_path)
    _tables(df.sparkSession).remove(df._sparkloom_path)


def mark(spark: SparkSession) -> int:
    """A moment, for :func:`clear`."""
    return len(_tables(spark))


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Removes the tables that operators wrote to the shared folder since :func:`mark`, but for ``keep``; results that were
    not stored elsewhere are lost."""
    tables, kept = _tables(spark), getattr(keep, "_sparkloom_path", None)
    gone = [t for t in tables[since:] if t != kept]
    tables[since:] = [t for t in tables[since:] if t == kept]
    for path in gone:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Before a stage in Python: long texts make Arrow batches of the default 10,000 rows large, so the session is set to
    hand over smaller ones, the same in all operators; and this package is sent to the executors, once for each context."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sent = spark.sparkContext.applicationId
    if sent not in _SENT:
        package = Path(__file__).parents[1]
        with zipfile.ZipFile(archive := Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom.zip", "w") as z:
            for f in package.rglob("*.py"):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SENT[sent] = str(archive)


def own(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return df["`" + name.replace("`", "``") + "`"]


def carried(df: DataFrame, names: list[str]) -> Column:
    """Columns as one struct, which a stage in Python hands through; inside they have names that clash with nothing."""
    return F.struct(*(own(df, c).alias(f"c{k}") for k, c in enumerate(names)))


def restored(struct: str, names: list[str]) -> list[Column]:
    """The columns of :func:`carried` under their own names."""
    return [F.col(f"{struct}.c{k}").alias(c) for k, c in enumerate(names)]


def text_bytes(column: str | Column) -> Column:
    """UTF-8 of a text, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never part the rows of one key; the input is sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = table.num_rows
        ends = [table.column(k)[last - 1].as_py() for k in keys]
        cut = _first_of_last_key(table, keys, ends)
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n = last - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _first_of_last_key(table: pa.Table, keys: list[str], ends: list) -> int:
    low, high = 0, table.num_rows - 1
    while low < high:
        middle = (low + high) // 2
        if [table.column(k)[middle].as_py() for k in keys] == ends:
            high = middle
        else:
            low = middle + 1
    return low
