"""Integrity and telemetry queries: key tables stand for registries and files, events for diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import integrity
from granary.registry import query, table


@query("orphans", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _orphans(spark, sf_dir):
    return integrity.orphans(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("orphans_by_source", "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY source")
def _orphan_counts(spark, sf_dir):
    return integrity.orphans(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("missing", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _missing(spark, sf_dir):
    return integrity.missing(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("dangling_registry", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def _dangling(spark, sf_dir):
    return integrity.missing(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), ["n_nationkey"])


@query("registered_only", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _registered(spark, sf_dir):
    good = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return integrity.registered_only(table(spark, sf_dir, "orders"), good, "o_custkey").select("o_orderkey")


@query("set_diff", "SELECT k, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'kept' END AS side FROM (SELECT coalesce(a, b) AS k, a, b FROM (SELECT DISTINCT o_custkey AS a FROM orders) FULL JOIN (SELECT c_custkey AS b FROM customer WHERE c_acctbal > 0) ON a = b)")
def _diff(spark, sf_dir):
    return integrity.three_way(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("lost_keys", "SELECT DISTINCT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 25")
def _lost(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).subtract(table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey"))


@query("index_verification", "SELECT 'documents' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'labels', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def _verify(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda df, name: df.distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return count(integrity.orphans(d, lab, ["doc_id"]), "documents").unionByName(count(integrity.missing(lab, d, ["doc_id"]), "labels"))


@query("severity_summary", """SELECT 'idle customers' AS "check", count(*) AS n, CASE WHEN count(*) = 0 THEN 'OK' WHEN count(*) >= 100 THEN 'ERROR' ELSE 'WARNING' END AS severity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
 UNION ALL SELECT 'empty nations', count(*), CASE WHEN count(*) = 0 THEN 'OK' WHEN count(*) >= 20 THEN 'ERROR' ELSE 'WARNING' END FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def _severity(spark, sf_dir):
    return integrity.severity([("idle customers", _missing(spark, sf_dir), 100), ("empty nations", _dangling(spark, sf_dir), 20)])


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("category"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(7)).cast("string")).alias("name"), (F.col("value") * 20).alias("value"))


_EV = "(SELECT event_id AS id, ts, event_type AS category, 'u' || user_id % 7 AS name, value * 20 AS value FROM events)"


@query("diag_errors", f"SELECT id, ts FROM {_EV} WHERE category = 'error' ORDER BY ts DESC, id DESC LIMIT 10")
def _errors(spark, sf_dir):
    return integrity.last_errors(events(spark, sf_dir)).select("id", "ts")


@query("diag_slow", f"SELECT id, category, value FROM {_EV} WHERE category = 'view' AND value > 500 ORDER BY ts DESC, id DESC LIMIT 10")
def _slow(spark, sf_dir):
    return integrity.slow(events(spark, sf_dir), category="view").select("id", "category", "value")


@query("diag_frequent", f"SELECT category || '/' || name AS what, count(*) AS n FROM {_EV} GROUP BY 1 ORDER BY n DESC, min(id) LIMIT 10")
def _frequent(spark, sf_dir):
    return integrity.frequent(events(spark, sf_dir))


@query("diag_avg", f"SELECT name, round(avg(value), 4) AS mean, count(*) AS n FROM {_EV} WHERE category = 'view' GROUP BY name")
def _avg(spark, sf_dir):
    return integrity.averages(events(spark, sf_dir), "view")


@query("ring_buffer", f"SELECT id FROM {_EV} ORDER BY ts DESC, id DESC LIMIT 1000")
def _ring(spark, sf_dir):
    return integrity.ring_buffer(events(spark, sf_dir)).select("id")


@query("trash_ttl", "SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AS expired FROM orders")
def _ttl(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return integrity.expired(rows, "o_orderdate", F.lit("1998-01-01").cast("timestamp"), 30 * 86400).select("o_orderkey", "expired")


@query("trash_listing", "SELECT o_custkey AS batch, count(*) AS n, max(o_orderdate) AS at FROM orders GROUP BY o_custkey")
def _trash(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.lit(None).cast("timestamp").alias("stamp"), F.col("o_orderdate").alias("modified"))
    return integrity.trash_listing(rows)


@query("outcome_counts", "SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1")
def _outcomes(spark, sf_dir):
    return integrity.outcome_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("outcome")))


_LINES = "(SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
_REASONS = f"(SELECT doc_id, CASE WHEN regexp_extract(line, '^([A-Z][a-z])', 1) = '' THEN 'other' ELSE regexp_extract(line, '^([A-Z][a-z])', 1) END AS reason, count(*) AS n, min(pos)::INTEGER AS first FROM {_LINES} GROUP BY 1, 2)"


def _log_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


@query("log_reasons", f"SELECT doc_id, reason, n, first FROM {_REASONS}")
def _reasons(spark, sf_dir):
    return integrity.log_reasons(_log_lines(spark, sf_dir), "^([A-Z][a-z])")


@query("log_top_reason", f"SELECT doc_id, reason, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM {_REASONS}) WHERE r = 1")
def _top_reason(spark, sf_dir):
    return integrity.top_reason(integrity.log_reasons(_log_lines(spark, sf_dir), "^([A-Z][a-z])"))


@query("garbage_split", "SELECT p_partkey, p_partkey IN (SELECT s_suppkey FROM supplier) OR p_size > 40 AS purge FROM part")
def _garbage(spark, sf_dir):
    listed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    return integrity.split_garbage(table(spark, sf_dir, "part"), listed, F.col("p_size") > 40, "p_partkey").select("p_partkey", "purge")


@query("page_agreement", "SELECT c.conv_id AS doc, count(s) AS n, round(avg(s), 6) AS mean, CASE WHEN count(s) = 0 THEN 'unknown' WHEN avg(s) < 0.12 THEN 'suspect' ELSE 'ok' END AS verdict FROM (SELECT conv_id, CASE WHEN role = 'assistant' THEN (length(text) % 100) / 400.0::DOUBLE END AS s FROM conversations) c GROUP BY 1")
def _gate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return integrity.page_gate(c.select(F.col("conv_id").alias("doc"), F.when(F.col("role") == "assistant", F.pmod(F.length("text"), F.lit(100)) / 400.0).alias("score")))


@query("layout_cascade", """WITH c AS (SELECT o_custkey AS page, o_orderkey AS layout, (o_orderkey * 37 % 1009) / 1009.0::DOUBLE AS agreement, o_orderkey % 7 AS scored, o_orderkey % 23 = 0 AS hinted, o_orderkey % 3 = 0 AND o_orderkey % 5 < 2 AS fits FROM orders)
 SELECT page, coalesce(arg_max(layout, (agreement, layout)) FILTER (WHERE scored >= 5), min(layout) FILTER (WHERE hinted), CASE WHEN count(*) FILTER (WHERE fits) = 1 THEN min(layout) FILTER (WHERE fits) END, arg_max(layout, (agreement, layout))) AS layout,
 CASE WHEN count(*) FILTER (WHERE scored >= 5) > 0 THEN 'agreement' WHEN count(*) FILTER (WHERE hinted) > 0 THEN 'hint' WHEN count(*) FILTER (WHERE fits) = 1 THEN 'geometry' ELSE 'tentative' END AS how FROM c GROUP BY page""")
def _cascade(spark, sf_dir):
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), k.alias("layout"), (F.pmod(k * 37, F.lit(1009)) / 1009.0).alias("agreement"), (k % 7).alias("scored"), (k % 23 == 0).alias("hinted"), (k % 3 * 2).alias("dcols"), F.when(k % 5 < 2, 0).otherwise(9).alias("drows"), F.lit(0.9).alias("conf"))
    return integrity.layout_choice(c)
