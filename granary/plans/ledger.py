"""Ledger queries: orders stand for payments and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import tolerant
from granary.operators import ledger
from granary.registry import query, table

_STATUS = {"F": "Pagado", "O": "En Progreso", "P": "Cotizado"}
_URGENCY = {"1-URGENT": "Ultra-urgente", "2-HIGH": "Urgente", "3-MEDIUM": "Normal"}
_TYPES = ("Apunte", "Tarea", "Guía", "Resumen", "Otro", "Dibujo")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in the form of a ledger, every seventh in ISO form, every eleventh unreadable; every thirteenth amount is no number."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    date = F.when(k % 11 == 0, F.lit("sin fecha")).when(k % 7 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return o.select(
        k.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("job_id"), F.lit("x").alias("concept"),
        F.when(k % 13 == 0, F.lit("abc")).otherwise(F.col("o_totalprice").cast("string")).alias("amount"), (k % 2 == 0).alias("is_advance"), date.alias("date"), k.alias("ord"),
    )


_PAYMENTS = """(SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS job_id, CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE o_totalprice END AS amount,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS paid, o_orderkey AS ord FROM orders)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pick = lambda m, c, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(c)), F.lit(other))
    pages = F.when(F.col("o_orderkey") % 17 == 0, F.lit("tres")).when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" "), (F.col("o_orderkey") % 40).cast("string"), F.lit(".0 "))).otherwise((F.col("o_orderkey") % 40 - 3).cast("string"))
    return o.select(
        F.col("o_custkey").cast("string").alias("client_name"), F.col("o_orderkey").cast("string").alias("id"), pages.alias("pages"), pick(_URGENCY, "o_orderpriority", "Sin prisa").alias("urgency"),
        F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("o_orderkey") % len(_TYPES) + 1).cast("int")).alias("job_type"), pick(_STATUS, "o_orderstatus", "Borrador").alias("status"),
        F.col("o_totalprice").cast("string").alias("price_mxn"), F.when(F.col("o_orderkey") % 9 == 0, F.lit("?")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("created_at"), F.col("o_orderkey").alias("ord"),
    )


_JOBS = """(SELECT o_custkey::VARCHAR AS client_name, o_orderkey::VARCHAR AS id,
 greatest(1, CASE WHEN o_orderkey % 17 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN o_orderkey % 40 ELSE o_orderkey % 40 - 3 END)::INTEGER AS pages,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Ultra-urgente' WHEN '2-HIGH' THEN 'Urgente' WHEN '3-MEDIUM' THEN 'Normal' ELSE 'Sin prisa' END AS urgency,
 (['Apunte', 'Tarea', 'Guía', 'Resumen', 'Otro', 'Dibujo'])[o_orderkey % 6 + 1] AS job_type,
 CASE o_orderstatus WHEN 'F' THEN 'Pagado' WHEN 'O' THEN 'En Progreso' WHEN 'P' THEN 'Cotizado' ELSE 'Borrador' END AS status,
 o_totalprice AS price, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS created, o_orderkey AS ord FROM orders)"""
_UF = "CASE urgency WHEN 'Urgente' THEN 1.5::DOUBLE WHEN 'Ultra-urgente' THEN 2.2::DOUBLE ELSE 1.0::DOUBLE END"
_TF = "CASE job_type WHEN 'Tarea' THEN 1.2::DOUBLE WHEN 'Guía' THEN 1.3::DOUBLE WHEN 'Resumen' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"
_PRICE = f"round(50.0::DOUBLE * pages * {_UF} * {_TF} * (1 + 0.015::DOUBLE * pages), 2)"


@query("ledger_total_income", f"SELECT round(coalesce(sum(amount), 0), 2)::DOUBLE AS total_income FROM {_PAYMENTS}")
def _total(spark, sf_dir):
    return ledger.total_income(payments(spark, sf_dir))


@query("ledger_monthly_income", f"SELECT year(paid)::INTEGER AS year, month(paid)::INTEGER AS month, round(sum(amount), 2)::DOUBLE AS income, count(*) AS n_payments FROM {_PAYMENTS} WHERE paid IS NOT NULL GROUP BY 1, 2")
def _monthly(spark, sf_dir):
    return ledger.monthly_income(payments(spark, sf_dir))


@query("ledger_one_month", f"SELECT 1997::INTEGER AS year, 5::INTEGER AS month, round(coalesce(sum(amount), 0), 2)::DOUBLE AS income FROM {_PAYMENTS} WHERE year(paid) = 1997 AND month(paid) = 5")
def _one_month(spark, sf_dir):
    return ledger.monthly_income(payments(spark, sf_dir), 1997, 5)


@query("ledger_active_count", f"SELECT count(*) FILTER (WHERE status IN ('Aceptado', 'En Progreso', 'Revisión')) AS active_jobs FROM {_JOBS}")
def _active(spark, sf_dir):
    return ledger.active_count(jobs(spark, sf_dir))


@query("ledger_pending_value", f"SELECT round(sum(CASE WHEN status IN ('Pagado', 'Cancelado') THEN 0 ELSE price END), 2)::DOUBLE AS pending_value FROM {_JOBS}")
def _pending(spark, sf_dir):
    return ledger.pending_value(jobs(spark, sf_dir))


@query("ledger_status_share", f"SELECT status, count(*) AS n_jobs, min(ord) AS first_ord, round(360.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS degrees FROM {_JOBS} GROUP BY status")
def _share(spark, sf_dir):
    return ledger.status_share(jobs(spark, sf_dir))


@query("ledger_dashboard", f"SELECT * FROM (SELECT count(*) FILTER (WHERE status = 'En Progreso') AS active_jobs, round(sum(CASE WHEN status = 'Pagado' THEN 0 ELSE price END), 2)::DOUBLE AS pending_value, count(*) AS n_jobs FROM {_JOBS}), (SELECT round(sum(amount), 2)::DOUBLE AS total_income FROM {_PAYMENTS})")
def _dashboard(spark, sf_dir):
    return ledger.dashboard(jobs(spark, sf_dir), payments(spark, sf_dir))


@query("ledger_jobs_sorted", f"SELECT id, status, created FROM {_JOBS}")
def _jobs_sorted(spark, sf_dir):
    return ledger.jobs_sorted(jobs(spark, sf_dir)).select("id", "status", "created")


@query("ledger_payments_sorted", f"SELECT id, amount::DOUBLE AS amount, paid AS paid_at FROM {_PAYMENTS}")
def _payments_sorted(spark, sf_dir):
    return ledger.payments_sorted(payments(spark, sf_dir)).select("id", tolerant.safe_amount(F.col("amount")).alias("amount"), "paid_at")


@query("ledger_payments_with_jobs", f"SELECT p.id, c_name AS job_client, c_mktsegment AS job_status FROM {_PAYMENTS} p LEFT JOIN customer ON job_id = c_custkey::VARCHAR")
def _payments_with_jobs(spark, sf_dir):
    clients = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("client_name"), F.col("c_mktsegment").alias("status"))
    return ledger.payments_with_jobs(payments(spark, sf_dir), clients).select("id", "job_client", "job_status")


@query("job_price", f"SELECT id, pages, {_PRICE} AS price FROM {_JOBS}")
def _price(spark, sf_dir):
    return jobs(spark, sf_dir).select("id", tolerant.safe_int(F.col("pages")).alias("pages"), tolerant.price(F.col("pages"), F.col("urgency"), F.col("job_type")).alias("price"))


@query("job_price_breakdown", f"SELECT id, round(50.0::DOUBLE * pages, 2) AS base, {_UF} AS urgency_multiplier, {_TF} AS type_multiplier, round(1 + 0.015::DOUBLE * pages, 3) AS complexity_factor, {_PRICE} AS total, round({_PRICE} * 0.5::DOUBLE, 2) AS advance_suggested FROM {_JOBS}")
def _breakdown(spark, sf_dir):
    return jobs(spark, sf_dir).select("id", tolerant.price_breakdown(F.col("pages"), F.col("urgency"), F.col("job_type")).alias("b")).select("id", "b.*")


_QUOTE = "'" + tolerant.QUOTE.replace("\n", "' || chr(10) || '") + "'"
for _name, _value in {"client": "client_name", "type": "lower(job_type)", "pages": "pages::VARCHAR", "urgency": "urgency", "total": f"format('{{:,.2f}}', {_PRICE})", "advance": f"format('{{:,.2f}}', round({_PRICE} * 0.5::DOUBLE, 2))", "deadline": "'Por acordar'"}.items():
    _QUOTE = _QUOTE.replace("{" + _name + "}", f"' || {_value} || '")


@query("quote_message", f"SELECT id, {_QUOTE} AS message FROM {_JOBS}")
def _quote(spark, sf_dir):
    total = tolerant.price(F.col("pages"), F.col("urgency"), F.col("job_type"))
    message = tolerant.quote_message(F.col("client_name"), F.col("job_type"), tolerant.safe_int(F.col("pages")).cast("string"), F.col("urgency"), F.lit(None).cast("string"), total)
    return jobs(spark, sf_dir).select("id", message.alias("message"))


@query("tolerant_parse", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN 0.0 ELSE coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) END AS amount,
 CASE WHEN event_id % 3 = 0 THEN greatest(1, trunc(value * 10000000000)::BIGINT) WHEN event_id % 3 = 1 THEN 1 ELSE greatest(1, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 1)) END::BIGINT AS whole FROM events""")
def _tolerant(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    large = F.when(F.col("event_id") % 3 == 0, (F.col("value") * 10_000_000_000).cast("string")).otherwise(raw)  # beyond 32 bits
    return e.select("event_id", tolerant.safe_amount(raw).alias("amount"), tolerant.safe_int(large).alias("whole"))


@query("multi_format_date", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE o_orderdate END AS parsed FROM orders")
def _dates(spark, sf_dir):
    k, d = F.col("o_orderkey") % 5, "o_orderdate"
    raw = F.when(k == 0, F.date_format(d, "d/M/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.lit("31/02/2024"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tolerant.parse_date(raw).alias("parsed"))


@query("ledger_upsert", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    changes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit("changed").alias("c_mktsegment"))
    return ledger.upsert(base, changes, "c_custkey")


@query("ledger_delete", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _delete(spark, sf_dir):
    return ledger.delete(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey")
