"""Ledger roll-ups over payments and jobs. Each is one pass with conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.tolerant import parse_date, safe_amount

# Job states, those that count as active, and those that owe nothing.
STATUSES = ("Borrador", "Cotizado", "Aceptado", "En Progreso", "Revisión", "Entregado", "Pagado", "Cancelado")
ACTIVE = ("Aceptado", "En Progreso", "Revisión")
SETTLED = ("Pagado", "Cancelado")

PAYMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "job_id", "client_name", "concept", "amount")] + [T.StructField("is_advance", T.BooleanType()), T.StructField("date", T.StringType())])
JOB = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "client_name", "client_phone", "job_type", "pages", "urgency", "deadline", "notes", "status", "price_mxn", "created_at", "modified_at")])
DEFAULTS = {"amount": "0", "is_advance": False, "status": "Borrador", "urgency": "Normal", "job_type": "Otro", "pages": "1", "price_mxn": "0"}


def total_income(payments: DataFrame) -> DataFrame:
    """The sum of all amounts to two decimals; 0 without payments."""
    return payments.agg(F.round(F.coalesce(F.sum(safe_amount(F.col("amount"))), F.lit(0.0)), 2).alias("total_income"))


def monthly_income(payments: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Income by year and month of the dated payments; with both given, that one month, 0 if it has none."""
    dated = payments.withColumn("_at", parse_date(F.col("date"))).where("_at IS NOT NULL")
    dated = dated.select(F.year("_at").alias("year"), F.month("_at").alias("month"), safe_amount(F.col("amount")).alias("a"))
    if year is None or month is None:
        return dated.groupBy("year", "month").agg(F.round(F.sum("a"), 2).alias("income"), F.count(F.lit(1)).alias("n_payments"))
    one = dated.where((F.col("year") == year) & (F.col("month") == month))
    return one.agg(F.lit(year).alias("year"), F.lit(month).alias("month"), F.round(F.coalesce(F.sum("a"), F.lit(0.0)), 2).alias("income"))


def active_count(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active_jobs"))


def _pending() -> Column:
    return F.when(~F.coalesce(F.col("status"), F.lit("")).isin(*SETTLED), safe_amount(F.col("price_mxn"))).otherwise(0.0)


def pending_value(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.round(F.coalesce(F.sum(_pending()), F.lit(0.0)), 2).alias("pending_value"))


def status_share(jobs: DataFrame) -> DataFrame:
    """Jobs and degrees of a full circle for each status, by its first place ``ord``."""
    by = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n_jobs"), F.min("ord").alias("first_ord"))
    total = by.agg(F.sum("n_jobs").alias("total"))  # one row
    return by.crossJoin(F.broadcast(total)).select("status", "n_jobs", "first_ord", F.round(360.0 * F.col("n_jobs") / F.col("total"), 4).alias("degrees"))


def dashboard(jobs: DataFrame, payments: DataFrame) -> DataFrame:
    """One row: total income, active jobs, pending value, number of jobs."""
    return jobs.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active_jobs"), F.round(F.coalesce(F.sum(_pending()), F.lit(0.0)), 2).alias("pending_value"), F.count(F.lit(1)).alias("n_jobs")).crossJoin(total_income(payments))


def jobs_sorted(jobs: DataFrame) -> DataFrame:
    """By creation, rows without a readable time first, then by place."""
    return jobs.withColumn("created", F.try_to_timestamp("created_at")).orderBy(F.col("created").asc_nulls_first(), "ord")


def payments_sorted(payments: DataFrame) -> DataFrame:
    """By date, rows without a readable date last, then by place."""
    return payments.withColumn("paid_at", parse_date(F.col("date"))).orderBy(F.col("paid_at").asc_nulls_last(), "ord")


def payments_with_jobs(payments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every payment with its job's client and status, null without one."""
    side = jobs.select(F.col("id").alias("job_id"), F.col("client_name").alias("job_client"), F.col("status").alias("job_status"))
    return payments.join(side, "job_id", "left")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Missing fields of a record get its defaults."""
    return rows.fillna({k: v for k, v in DEFAULTS.items() if k in rows.columns})


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", stamp: str = "modified_at", now: Column | None = None) -> DataFrame:
    """Rows of ``table`` whose key ``changes`` holds are replaced and stamped; new keys are not added."""
    new = changes.join(table.select(key), key, "left_semi").select(*table.columns)
    if stamp in table.columns and now is not None:
        new = new.withColumn(stamp, now.cast(table.schema[stamp].dataType))
    return table.join(changes.select(key), key, "left_anti").unionByName(new.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")
