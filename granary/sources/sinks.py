"""Writers: whole tables swapped in at once, partitioned stores, reports, guarded deletion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str, form: str = "parquet", backup: bool = False) -> None:
    """Writes beside ``path`` and then renames, so that readers see the old table or the new one; the rows may come from
    ``path`` itself. With ``backup`` the old table stays as path.bak."""
    spark, path = df.sparkSession, path.rstrip("/")
    fresh = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.format(form).save(fresh)
    there, fs = _fs(spark, path)
    new, old = _fs(spark, fresh)[0], _fs(spark, f"{path}.bak" if backup else f"{fresh}.old")[0]
    if fs.exists(there):
        fs.delete(old, True)
        fs.rename(there, old)
    if not fs.rename(new, there):
        raise OSError(f"{fresh} could not be moved to {path}")
    if not backup:
        fs.delete(old, True)


def by_profile(df: DataFrame, path: str) -> None:
    """A store with a folder for each profile; only the profiles in ``df`` are written anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile_id").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def report(df: DataFrame, path: str, form: str = "csv") -> None:
    """Rows as CSV with a header, or as JSON lines."""
    df.write.mode("overwrite").option("header", True).format(form).save(path)


def remove(spark: SparkSession, path: str, root: str) -> bool:
    """Deletes a path inside ``root``; anything else is refused."""
    where, fs = _fs(spark, path)
    inside = fs.makeQualified(_fs(spark, root)[0]).toString().rstrip("/")
    if ".." in path.split("/") or not fs.makeQualified(where).toString().startswith(f"{inside}/"):
        raise ValueError(f"{path} is not inside {root}")
    return fs.delete(where, True)


def split_save(df: DataFrame, reason: str, accepted: str, rejected: str) -> None:
    """Rows without a reason to one table and the others, the log of refusals, to another."""
    df.where(F.col(reason).isNull()).drop(reason).write.mode("append").parquet(accepted)
    df.where(F.col(reason).isNotNull()).write.mode("append").parquet(rejected)
