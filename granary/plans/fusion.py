"""Fusion queries: line items stand for detected boxes, events for predictions, conversations for lines to align."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from granary.operators import fusion
from granary.registry import query, table


def boxes(spark, sf_dir):
    """One box a line item; the order modulo 500 is the image, the line number's parity the detector."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.pmod("l_orderkey", F.lit(500)).alias("image_id"), F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], F.col("l_quantity").cast("int").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("id"),
        F.concat(F.lit("d"), F.pmod("l_linenumber", F.lit(2)).cast("string")).alias("detector"), F.pmod(F.col("l_partkey") * 13, F.lit(600)).alias("x"), F.pmod(F.col("l_suppkey") * 29, F.lit(400)).alias("y"),
        (F.col("l_quantity").cast("long") + 5).alias("w"), (F.pmod("l_partkey", F.lit(30)) + 10).alias("h"),
    )


_BOX = """(SELECT l_orderkey % 500 AS image_id, concat_ws('/', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR, l_quantity::INTEGER::VARCHAR, round(l_extendedprice * 100)::BIGINT::VARCHAR) AS id, 'd' || l_linenumber % 2 AS detector,
 l_partkey * 13 % 600 AS x, l_suppkey * 29 % 400 AS y, l_quantity::BIGINT + 5 AS w, l_partkey % 30 + 10 AS h FROM lineitem)"""
_INTER = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"
_IOU = f"({_INTER})::DOUBLE / (a.w * a.h + b.w * b.h - {_INTER})"


def _sides(spark, sf_dir):
    b = boxes(spark, sf_dir).dropDuplicates(["image_id", "id"])
    return b.where("detector = 'd0'"), b.where("detector = 'd1'")


_A = f"(SELECT DISTINCT * FROM {_BOX} WHERE detector = 'd0')"
_B = f"(SELECT DISTINCT * FROM {_BOX} WHERE detector = 'd1')"


@query("box_iou", f"SELECT a.image_id, a.id AS a, b.id AS b, round({_IOU}, 6) AS iou FROM {_A} a JOIN {_B} b ON a.image_id = b.image_id WHERE {_IOU} >= 0.3")
def _iou(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return fusion.overlapping(a, b, 0.3).withColumn("iou", F.round("iou", 6))


@query("box_region_mask", f"""SELECT image_id, id FROM (SELECT a.image_id, a.id, inside, bool_or(inside) OVER (PARTITION BY a.image_id) AS any_in FROM (SELECT a.image_id, a.id, bool_or(coalesce({_INTER} >= 0.5 * (a.w * a.h), false)) AS inside FROM {_A} a LEFT JOIN
 (SELECT image_id, 0 AS x, 0 AS y, 150 + image_id % 200 AS w, 120 AS h FROM (SELECT DISTINCT image_id FROM {_A})) b ON a.image_id = b.image_id GROUP BY a.image_id, a.id) a) WHERE inside OR NOT any_in""")
def _regions(spark, sf_dir):
    a, _ = _sides(spark, sf_dir)
    regions = a.select("image_id").distinct().select("image_id", F.lit(0).alias("x"), F.lit(0).alias("y"), (150 + F.pmod("image_id", F.lit(200))).alias("w"), F.lit(120).alias("h"))
    return fusion.in_regions(a, regions).select("image_id", "id")


@query("box_gapfill", f"SELECT image_id, id, detector FROM {_A} UNION ALL SELECT image_id, id, detector FROM {_B} a WHERE NOT EXISTS (SELECT 1 FROM {_A} b WHERE a.image_id = b.image_id AND ({_INTER})::DOUBLE / (a.w * a.h) >= 0.3)")
def _gapfill(spark, sf_dir):
    return fusion.fill_gaps(*_sides(spark, sf_dir)).select("image_id", "id", "detector")


@query("box_union")
def _union(spark, sf_dir):
    return fusion.fuse_greedy(boxes(spark, sf_dir).withColumn("ord", F.xxhash64("id")), 0.3)


@query("box_quorum", f"""SELECT image_id, x // 60 AS "group", count(DISTINCT detector) AS votes, round(count(DISTINCT detector) / 3.0::DOUBLE, 4) AS agreement FROM {_BOX} GROUP BY 1, 2 HAVING count(DISTINCT detector) >= 2""")
def _quorum(spark, sf_dir):
    """Three detectors ran, one of which found nothing."""
    return fusion.quorum_groups(boxes(spark, sf_dir).select("image_id", F.floor(F.col("x") / 60).alias("group"), "detector"), 3)


@query("box_fused_quorum")
def _fused(spark, sf_dir):
    return fusion.fuse_greedy(boxes(spark, sf_dir).withColumn("ord", F.xxhash64("id")), 0.3, quorum=True, detectors=3)


@query("box_match")
def _match(spark, sf_dir):
    b = boxes(spark, sf_dir)  # an id matches once, so that copies need not go first
    return fusion.match_greedy(b.where("detector = 'd0'"), b.where("detector = 'd1'"), 0.2)


@query("eval_metrics")
def _evaluation(spark, sf_dir):
    m = _match(spark, sf_dir).withColumn("true_char", F.substring("a", -1, 1)).withColumn("char", F.substring("b", -1, 1))
    return fusion.evaluation(m, boxes(spark, sf_dir).where("detector = 'd0'").select("image_id", "id").distinct())


@query("reading_order", f"SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY floor(y / greatest(0.6::DOUBLE * m, 1.0)), x, id)::INTEGER AS ord FROM (SELECT *, median(h) OVER (PARTITION BY image_id) AS m FROM {_A})")
def _order(spark, sf_dir):
    return fusion.reading_order(_sides(spark, sf_dir)[0]).select("image_id", "id", "ord")


@query("zip_expected", f"SELECT image_id, id, substr('abcdefghijklmnopqrstuvwxyz', ord::INTEGER, 1) AS char FROM (SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY floor(y / greatest(0.6::DOUBLE * m, 1.0)), x, id) AS ord FROM (SELECT *, median(h) OVER (PARTITION BY image_id) AS m FROM {_A})) WHERE ord <= 26")
def _zip(spark, sf_dir):
    ordered = fusion.reading_order(_sides(spark, sf_dir)[0]).select("image_id", "id", "ord")
    chars = ordered.select("image_id").distinct().select("image_id", F.posexplode(F.split(F.lit("abcdefghijklmnopqrstuvwxyz"), "")).alias("ord", "char")).where("char <> ''").withColumn("ord", F.col("ord") + 1)
    return fusion.zip_expected(ordered, chars).where("char IS NOT NULL").select("image_id", "id", "char")


def predictions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 5).alias("item_id"), F.pmod("event_id", F.lit(5)).cast("int").alias("ord"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.substring("event_type", 1, 1)).alias("char"), F.round(F.pmod("value", F.lit(1.0)), 2).alias("conf"))


_PRED = "(SELECT event_id // 5 AS item_id, event_id % 5 AS ord, CASE WHEN event_id % 11 = 0 THEN '?' ELSE substr(event_type, 1, 1) END AS char, round(value % 1.0, 2) AS conf FROM events)"


@query("vote_majority", f"""SELECT item_id, char, round(mean, 4) AS conf, n >= (total + 1) // 2 AS consensus FROM (SELECT item_id, char, count(*) AS n, avg(conf) AS mean, sum(count(*)) OVER (PARTITION BY item_id) AS total,
 row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, round(avg(conf), 9) DESC, min(ord)) AS r FROM {_PRED} GROUP BY 1, 2) WHERE r = 1""")
def _majority(spark, sf_dir):
    return fusion.vote(predictions(spark, sf_dir), "majority")


@query("vote_highest", f"SELECT item_id, char, round(conf, 4) AS conf, k = 1 AS consensus FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY conf DESC, ord) AS r FROM {_PRED}) JOIN (SELECT item_id, count(DISTINCT char) AS k FROM {_PRED} GROUP BY 1) USING (item_id) WHERE r = 1")
def _highest(spark, sf_dir):
    return fusion.vote(predictions(spark, sf_dir), "highest")


@query("vote_consensus", f"SELECT item_id, CASE WHEN count(DISTINCT char) = 1 THEN min(char) ELSE '?' END AS char, round(avg(conf) / CASE WHEN count(DISTINCT char) = 1 THEN 1 ELSE 2 END, 3) AS conf, count(DISTINCT char) = 1 AS consensus FROM {_PRED} GROUP BY item_id")
def _consensus(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return fusion.vote(rows, "consensus").withColumn("conf", F.col("conf")).join(rows.groupBy("item_id").agg(F.avg("conf").alias("_m"), F.countDistinct("char").alias("_k")), "item_id").select("item_id", "char", F.round(F.col("_m") / F.when(F.col("consensus"), 1).otherwise(2), 3).alias("conf"), "consensus")


def _glyphs(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes show all characters but spaces and each ninth one; some are narrow and some wide."""
    widths = np.where(np.isin(codes, [ord(x) for x in "ilt"]), 0.5, np.where(np.isin(codes, [ord(x) for x in "mw"]), 1.4, 1.0))
    return (codes != ord(" ")) & (places % 9 != 4), widths


@query("nw_align")
def _align(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("line_id"), "turn", "text")
    return fusion.align_texts(c, "text", _glyphs).select("line_id", "turn", "box_ord", "char_ord")


@query("metric_verdict", """SELECT metric, round(r, 6) AS real, round(m, 6) AS made, CASE WHEN metric = 'n_lines' THEN 'info' WHEN metric = 'slant' THEN CASE WHEN abs(m - r) <= 1.5 THEN 'ok' ELSE 'off' END WHEN abs(m - r) <= 0.3::DOUBLE * abs(r) THEN 'ok' ELSE 'off' END AS verdict
 FROM (SELECT 'slant' AS metric, avg(l_quantity) AS r, avg(l_quantity) + 1 AS m FROM lineitem UNION ALL SELECT 'price', avg(l_extendedprice), 1.5::DOUBLE * avg(l_extendedprice) FROM lineitem UNION ALL SELECT 'n_lines', count(*), 2 * count(*) FROM lineitem)""")
def _verdict(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    row = li.agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    real = row.selectExpr("stack(3, 'slant', q, 'price', p, 'n_lines', n) AS (metric, value)")
    made = row.selectExpr("stack(3, 'slant', q + 1, 'price', 1.5D * p, 'n_lines', 2 * n) AS (metric, value)")
    return fusion.verdicts(real, made).select("metric", F.round("real", 6).alias("real"), F.round("made", 6).alias("made"), "verdict")
