"""Queries of geometry and of options derived from statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import geometry
from granary.registry import query, table


@query("slant", "SELECT user_id, round(CASE WHEN var_pop(event_id % 50) > 0 THEN degrees(atan(covar_pop(value, event_id % 50) / var_pop(event_id % 50))) ELSE 0 END, 5) AS slant FROM events GROUP BY 1")
def _slant(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(geometry.slant(F.col("value"), F.col("event_id") % 50), 5).alias("slant"))


@query("grid_rects", "SELECT p_partkey, (p_partkey // 9)::INTEGER AS row, (p_partkey % 9)::INTEGER AS col, (40 + p_partkey % 9 * 30)::INTEGER AS x, (25 + p_partkey // 9 * 20)::INTEGER AS y, 30::INTEGER AS w, 20::INTEGER AS h FROM part")
def _grid(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", geometry.grid_rect(F.col("p_partkey"), 9, 40, 25, 30, 20).alias("r")).select("p_partkey", "r.*")


@query("unit_conversion", "SELECT p_partkey, round_even(p_size * 300 / 25.4::DOUBLE, 0)::INTEGER AS px, round(p_size * 25.4::DOUBLE / 300, 6) AS mm FROM part")
def _units(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", geometry.to_pixels(F.col("p_size"), 300).alias("px"), F.round(geometry.to_mm(F.col("p_size"), 300), 6).alias("mm"))


@query("calibrated_options", "SELECT event_type, round(least(greatest(avg(value) * 0.1::DOUBLE, 0.5), 3.0), 6) AS spread, round(least(greatest(stddev_pop(value) * 0.05::DOUBLE, 0.0), 1.0), 6) AS jitter FROM events GROUP BY 1")
def _options(spark, sf_dir):
    limits = {"spread": (0.1, 0.5, 3.0), "jitter": (0.05, 0.0, 1.0)}
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(geometry.options_of({"spread": F.avg("value"), "jitter": F.stddev_pop("value")}, limits).alias("o"))
    return by.select("event_type", F.round("o.spread", 6).alias("spread"), F.round("o.jitter", 6).alias("jitter"))


@query("metrics_snapshot", """SELECT event_type, '{"source":"' || event_type || '","taken_at":"2026-01-01 00:00:00","metrics":{"n":' || count(*) || '}}' AS doc FROM events GROUP BY 1""")
def _snapshot(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.select("event_type", geometry.snapshot(F.col("event_type"), F.lit("2026-01-01 00:00:00"), n=F.col("n")).alias("doc"))
