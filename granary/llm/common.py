"""Helpers that the corpus operators share: shared-folder tables, row splits and bounded parts of batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define a word boundary.
SPACE = r"[\x20\x09-\x0D]+"
#: 64-bit words of the bitmap of row markers.
_WORDS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local master, where driver and executors are one process, may leave it unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.gettempdir()}/granary-checkpoints"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    The files go when the Python driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of the column as text, modulo ``divisor``; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text in column ``at``; a longer text is a part of its own.
    No text becomes a Python object before its part's turn."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).astype(np.int64)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)


def release() -> None:
    """Gives memory that a finished task has freed back to the system; Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _bitmap(rows: DataFrame, marks: DataFrame, mark: str, hit: str) -> DataFrame:
    """``rows`` with whether their mark may be among ``marks``, from a broadcast bitmap of 2**25 bits; certain if false."""
    word, bit = F.pmod(F.xxhash64(F.shiftright(mark, 6)), F.lit(_WORDS)).cast("int"), F.expr(f"shiftleft(1L, cast(`{mark}` & 63 AS int))")
    words = marks.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))  # _WORDS rows at most
    found = rows.withColumn("_at", word).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    return found.withColumn(hit, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_at", "_word", "_bits")


def with_marks(rows: DataFrame, marks: DataFrame, mark: str) -> DataFrame:
    """The rows whose mark is among ``marks``; only rows that the bitmap lets through are shuffled."""
    hit = fresh(rows, "_hit")
    return _bitmap(rows, marks, mark, hit).where(hit).drop(hit).hint("merge").join(marks.hint("merge"), mark, "left_semi")


def without_marks(rows: DataFrame, marks: DataFrame, mark: str) -> DataFrame:
    """The rows whose mark is not among ``marks``; only rows that the bitmap lets through are shuffled."""
    hit = fresh(rows, "_hit")
    tested = _bitmap(rows, marks, mark, hit)
    maybe = tested.where(hit).drop(hit).hint("merge").join(marks.hint("merge"), mark, "left_anti")
    return tested.where(~F.col(hit)).drop(hit).unionByName(maybe)
