"""Layout and signal queries: events of a user stand for a line of ordered boxes or a signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import layout
from granary.registry import query, table


def signal(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))


_SIG = "(SELECT user_id, event_id::DOUBLE AS x, value AS y FROM events)"


@query("gap_stats", """WITH g AS (SELECT user_id, gap FROM (SELECT user_id, event_id - lag(event_id + 3) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) WHERE gap > 0),
 m AS (SELECT user_id, count(*)::INTEGER AS n_gaps, (list_sort(list(gap)))[count(*) // 2 + 1] AS mid FROM g GROUP BY 1) SELECT user_id, n_gaps, mid, count(*) FILTER (WHERE gap > 2.5 * mid) AS n_wide FROM g JOIN m USING (user_id) GROUP BY 1, 2, 3""")
def _gaps(spark, sf_dir):
    return layout.gap_stats(table(spark, sf_dir, "events").select("user_id", "event_id", F.lit(3).alias("w")), "user_id", "event_id", "w")


_LINE = "PARTITION BY user_id, line"


def _resid(src: str, more: str = "") -> str:
    return f"(SELECT *, y - coalesce(regr_slope(y, x) OVER ({_LINE}), 0) * x - coalesce(regr_intercept(y, x) OVER ({_LINE}), 0) AS resid {more} FROM {src})"


_LONG = f"(SELECT * FROM (SELECT user_id, x::BIGINT % 3 AS line, x, y, count(*) OVER (PARTITION BY user_id, x::BIGINT % 3) AS n FROM {_SIG}) WHERE n >= 4)"
_FIRST = f"(SELECT *, abs(resid) <= 1.8 * d AS inside FROM (SELECT *, stddev_pop(resid) OVER ({_LINE}) AS d FROM {_resid(_LONG)}))"
_TWO = f"(SELECT *, d > 1e-9 AND count(*) FILTER (WHERE inside) OVER ({_LINE}) >= 4 AS again FROM {_FIRST})"
_LAST = f"(SELECT user_id, line, x, resid FROM {_TWO} WHERE NOT again UNION ALL SELECT user_id, line, x, resid FROM {_resid(f'(SELECT * EXCLUDE (resid) FROM {_TWO} WHERE again AND inside)')})"


@query("baseline_autocorr", f"SELECT user_id, count(*) AS n, round(stddev_pop(resid), 5) AS sigma, round(CASE WHEN sum(resid * resid) > 0 THEN coalesce(sum(resid * prev), 0) / sum(resid * resid) ELSE 0 END, 5) AS autocorr FROM (SELECT *, lag(resid) OVER ({_LINE} ORDER BY x) AS prev FROM {_LAST}) GROUP BY 1")
def _baseline(spark, sf_dir):
    rows = signal(spark, sf_dir).withColumn("line", F.pmod(F.col("x").cast("long"), F.lit(3)))
    return layout.baseline(rows, "user_id", "line", "x", "y").select("user_id", "n", F.round("sigma", 5).alias("sigma"), F.round("autocorr", 5).alias("autocorr"))


@query("margin_stats", """SELECT user_id, CASE WHEN n < 3 THEN 0.0 ELSE round(coalesce(sum(d * p), 0) / sum(d * d), 5) END AS margin_autocorr, CASE WHEN n < 3 THEN 0.0 ELSE round(arg_min(d, x), 5) END AS first_indent, CASE WHEN n < 3 THEN 0.0 ELSE round(stddev_pop(z) / avg(z), 5) END AS right_cv FROM
 (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY x) AS p FROM (SELECT user_id, event_id AS x, value - median(value) OVER (PARTITION BY user_id) AS d, value + event_id % 10 AS z, count(*) OVER (PARTITION BY user_id) AS n FROM events)) GROUP BY user_id, n""")
def _margins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), F.col("value").alias("l"), (F.col("value") + F.col("event_id") % 10).alias("r"))
    out = layout.margins(rows, "user_id", "x", "l", "r")
    return out.select("user_id", *[F.round(c, 5).alias(c) for c in ("margin_autocorr", "first_indent", "right_cv")])


@query("paragraph_starts", """WITH l AS (SELECT user_id, event_id, step, line FROM (SELECT user_id, event_id, event_id - lag(event_id) OVER w AS step, row_number() OVER w AS line FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))),
 r AS (SELECT user_id, step, row_number() OVER (PARTITION BY user_id ORDER BY step) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM l WHERE line > 1),
 m AS (SELECT user_id, median(step) AS base, max(n) AS n FROM r WHERE r <= greatest(n // 2, 1) GROUP BY 1)
 SELECT user_id, event_id, line = 1 OR coalesce(n >= 2 AND base > 0 AND step > 1.6::DOUBLE * base, false) AS starts FROM l LEFT JOIN m USING (user_id)""")
def _starts(spark, sf_dir):
    return layout.paragraph_starts(table(spark, sf_dir, "events"), "user_id", "event_id", "event_id")


@query("value_spread", "SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sigma, round(CASE WHEN avg(value) <> 0 THEN stddev_pop(value) / avg(value) ELSE 0 END, 6) AS cv FROM events GROUP BY 1")
def _spread(spark, sf_dir):
    return layout.spread(table(spark, sf_dir, "events"), "user_id", "value").select("user_id", *[F.round(c, 6).alias(c) for c in ("mean", "sigma", "cv")])


@query("otsu", """WITH h AS (SELECT l_suppkey AS k, (l_quantity * 5)::INTEGER AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT k, v, sum(n) OVER u AS w0, sum(n * v) OVER u AS s0, sum(n) OVER (PARTITION BY k) AS w, sum(n * v) OVER (PARTITION BY k) AS s FROM h WINDOW u AS (PARTITION BY k ORDER BY v))
 SELECT k, v AS threshold FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY round(CASE WHEN w > w0 THEN w0::DOUBLE * (w - w0) * pow(s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0), 2) ELSE 0 END, 3) DESC, v) AS r FROM c) WHERE r = 1""")
def _otsu(spark, sf_dir):
    return layout.otsu(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_quantity") * 5).alias("v")), "k", "v")


_RUNS = "(SELECT user_id, min(n) AS start, count(*) AS length FROM (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM (SELECT user_id, value > 10 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE f) GROUP BY user_id, g)"


@query("runs", f"SELECT user_id, start::INTEGER AS start, length FROM {_RUNS}")
def _runs(spark, sf_dir):
    return layout.runs(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") > 10)


@query("longest_run", f"SELECT user_id, max(length) AS longest, count(*) AS n_runs FROM {_RUNS} GROUP BY 1")
def _longest(spark, sf_dir):
    return layout.longest_run(_runs(spark, sf_dir), "user_id")


@query("merge_bands", f"""WITH b AS (SELECT user_id, start, length, median(length) OVER (PARTITION BY user_id) AS m, start - lag(start + length) OVER (PARTITION BY user_id ORDER BY start) AS gap FROM {_RUNS}), g AS (SELECT *, sum(coalesce(gap >= 0.6 * m, true)::INTEGER) OVER (PARTITION BY user_id ORDER BY start) AS g FROM b)
 SELECT user_id, min(start)::INTEGER AS start, (max(start + length) - min(start))::BIGINT AS length FROM g GROUP BY user_id, g""")
def _bands(spark, sf_dir):
    return layout.merge_bands(_runs(spark, sf_dir), "user_id")


@query("local_minima", """SELECT user_id, event_id, value, round(least(l, r) - value, 6) AS prominence FROM (SELECT user_id, event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
 max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE value < a AND value < b""")
def _minima(spark, sf_dir):
    return layout.local_minima(table(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("prominence", F.round("prominence", 6))


def _hours(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("pos")).agg(F.count(F.lit(1)).cast("double").alias("value"))


_HOURS = "(SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS pos, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2)"


@query("autocorr_period", f"""WITH d AS (SELECT event_type, pos, value - avg(value) OVER (PARTITION BY event_type) AS d, max(pos) OVER (PARTITION BY event_type) - min(pos) OVER (PARTITION BY event_type) + 1 AS span FROM {_HOURS}),
 z AS (SELECT event_type, any_value(span) AS span, sum(d * d) AS z FROM d GROUP BY 1), lags AS (SELECT event_type, span, z, unnest(range(greatest(span // 20, 2) - 1, greatest(span // 3, 3) + 1)) AS lag FROM z),
 c AS (SELECT l.event_type, l.lag, l.span, round(sum(a.d * b.d) / any_value(l.z), 9) AS r FROM lags l JOIN d a ON a.event_type = l.event_type JOIN d b ON b.event_type = a.event_type AND b.pos = a.pos + l.lag GROUP BY 1, 2, 3),
 p AS (SELECT *, lag(r) OVER w AS a, lead(r) OVER w AS b FROM c WINDOW w AS (PARTITION BY event_type ORDER BY lag))
 SELECT event_type, lag AS period, round(r, 6) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY r DESC, lag) AS best FROM p WHERE r > a AND r >= b AND r > 0 AND lag >= greatest(span // 20, 2) AND lag < greatest(span // 3, 3)) WHERE best = 1""")
def _period(spark, sf_dir):
    return layout.period(_hours(spark, sf_dir), "event_type", "pos", "value").withColumn("strength", F.round("strength", 6))


@query("paginate", "SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8)::INTEGER AS page, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 8)::INTEGER AS slot FROM events")
def _paginate(spark, sf_dir):
    return layout.paginate(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 250, 30)


@query("soft_wrap")
def _wrap(spark, sf_dir):
    lines = layout.wrapped(F.col("text"), 60)
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).select("doc_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


@query("page_flow")
def _flow(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.ceil(F.length("text") / 60).cast("int").alias("h")))).alias("t"))
    return c.select("conv_id", layout.flow_pages(F.transform("t", lambda x: x["h"]), 40, 2).alias("pages"))


@query("bounded_walk")
def _walk(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.pmod(F.col("value"), F.lit(1.0)) - 0.5).alias("e")))).alias("t"))
    return e.select("user_id", layout.bounded_walk(F.transform("t", lambda x: x["e"])).alias("walk"))
