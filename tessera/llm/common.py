"""Helpers shared by the operators: input tables, the shared work folder, and chunked Arrow input."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of so many rows of two or three numbers is small enough to broadcast (some 50 MB as a hash table).
BROADCAST_ROWS = 500_000
#: Bytes of text that a Python worker works on at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Turns Parquet's vectored reads off, which keep a direct buffer as large as a column chunk for each I/O thread,
    makes batches for Python small unless the session has a size of its own, and sends this package to the Python workers,
    once for each Spark context."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", None) is None:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()  # the driver's own: executors fetch the file from the driver
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/tessera.zip", "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"tessera/{f.relative_to(package)}")
        context.addPyFile(f"{folder}/tessera.zip")
        context._tessera_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local session without the setting gets its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lost executors don't cost a recomputation. What nothing
    removes before goes when the driver's Python ends, if the session is still there."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    atexit.register(_leave, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def _leave(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a work folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def limited(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast join if it has BROADCAST_ROWS rows or fewer; a larger one is left to a sort-merge join.
    df is read to be counted, so it should be a written table."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; the built-in lower() serves where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.names.index(name)).cast(pa.binary()).to_pylist()]


def chunked(rows: Iterator[tuple], size: Callable[[tuple], int], limit: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Groups rows into lists of about limit bytes."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        n = size(row)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held


def id_texts(batches: Iterator[pa.RecordBatch], id_col: str = "doc_id", text: str = "text") -> Iterator[list[tuple]]:
    """(id, UTF-8 bytes) pairs of a stream of batches, in chunks of bounded size."""

    def rows():
        for b in batches:
            yield from zip(b.column(id_col).to_pylist(), binary(b, text), strict=True)

    return chunked(rows(), lambda r: len(r[1]) + 64)
