"""Ranking queries over parts, benchmark items and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import ranking
from granary.registry import query, table


def commands(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("label"), F.concat_ws(" ", "p_type", "p_brand").alias("keywords"))


_QUERY = "sm ri"


def _fuzzy_sql(q: str) -> str:
    """One step a character: the places it is found at next, from every place of the first one."""
    start = lambda at: f"CASE WHEN {at} = 1 OR contains(' ' || chr(9) || '_-./:·', substr(t, {at} - 1, 1)) THEN 2.0 ELSE 0.0 END"
    steps = [f"w0 AS (SELECT id, k, t, a AS z, 1.0 + {start('a')} AS p FROM (SELECT *, unnest(range(1, length(t) + 1)) AS a FROM t) WHERE substr(t, a, 1) = '{q[0]}')"]
    for i, c in enumerate(q[1:]):
        steps.append(f"w{i + 1} AS (SELECT id, k, t, z + d AS z, p + 1.0 + {start('(z + d)')} + CASE WHEN d = 1 THEN 1.5 ELSE 0.0 END AS p FROM (SELECT *, strpos(substr(t, z + 1), '{c}') AS d FROM w{i}) WHERE d > 0)")
    best = f"SELECT id, max(k * (p + CASE WHEN starts_with(t, '{q}') THEN 2.0 * {len(q)} ELSE 0.0 END))::DOUBLE AS score FROM w{len(q) - 1} GROUP BY id"
    texts = "SELECT p_partkey AS id, lower(p_name) AS t, 1.0 AS k FROM part UNION ALL SELECT p_partkey, lower(p_type || ' ' || p_brand), 0.8 FROM part"
    return f"WITH t AS ({texts}), {', '.join(steps)} SELECT id, id AS ord, p_name AS label, score FROM ({best}) JOIN part ON p_partkey = id ORDER BY score DESC, id LIMIT 8"


@query("fuzzy_rank", _fuzzy_sql(_QUERY))
def _fuzzy(spark, sf_dir):
    return ranking.fuzzy_rank(commands(spark, sf_dir), _QUERY)


@query("fuzzy_rank_all", "SELECT p_partkey AS id, p_partkey AS ord, p_name AS label, 1.0::DOUBLE AS score FROM part")
def _fuzzy_all(spark, sf_dir):
    return ranking.fuzzy_rank(commands(spark, sf_dir), " ")


@query("substring_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring')")
def _search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("ring")).select("p_partkey")


@query("ocr_similarity")
def _similarity(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.round(ranking.similarity(F.col("text"), F.regexp_replace("text", "th", "t")), 6).alias("ratio"))


@query("variant_sampling")
def _sampling(spark, sf_dir):
    from .store import entries

    rows = entries(spark, sf_dir)
    turns = rows.select("char").distinct().select("char", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long"))).alias("turn"))
    return ranking.sample_variants(rows, turns)


@query("pen_route")
def _route(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ranking.nearest_route(e.select(F.col("user_id").alias("page"), F.col("event_id").alias("stroke"), (F.col("event_id") % 97).cast("double").alias("x0"), (F.col("event_id") % 89).cast("double").alias("y0"), (F.col("event_id") % 83).cast("double").alias("x1"), (F.col("event_id") % 79).cast("double").alias("y1")))


@query("top_classes", """SELECT vec_id, unnest(list_slice(c, 1, 3)).c AS class, round(unnest(list_slice(c, 1, 3)).p, 6) AS p FROM (SELECT vec_id, list_sort(list_transform(range(64), lambda i: {'n': -e[i + 1] / s, 'c': i::INTEGER, 'p': e[i + 1] / s})) AS c FROM
 (SELECT vec_id, e, list_sum(e) AS s FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings)))""")
def _top(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.explode(ranking.top_classes(F.col("e"), 3)).alias("t")).select("vec_id", F.col("t.class").alias("class"), F.round("t.p", 6).alias("p"))
