"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import records
from granary.registry import query, table

from .store import _PART, entries


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("shape_counts", "SELECT count(*) FILTER (WHERE s AND l_discount >= 0.02) AS kept, count(*) FILTER (WHERE NOT s) AS dropped_shape, count(*) FILTER (WHERE s AND l_discount < 0.02) AS dropped_ink FROM (SELECT l_discount, coalesce(l_quantity > 1 AND l_linenumber > 1 AND (l_quantity - 1) / (l_linenumber - 1) BETWEEN 0.12 AND 6, false) AS s FROM lineitem)")
def _shapes(spark, sf_dir):
    return records.shape_counts(table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 1).alias("w"), (F.col("l_linenumber") - 1).alias("h"), F.col("l_discount").alias("ink")))


@query("acceptance_gates", f"SELECT id, CASE WHEN score < 0.2 THEN 'confidence' WHEN id % 10 = 0 THEN 'alphabet' WHEN score < 0.5 THEN 'quality' END AS reason FROM {_PART}")
def _gates(spark, sf_dir):
    char = F.when(F.col("id") % 10 == 0, "&").otherwise(F.when(F.col("id") % 10 == 1, "?").otherwise("ñ"))
    return entries(spark, sf_dir).select("id", records.gate_reason(F.col("score"), char, F.col("score"), 0.2, 0.5).alias("reason"))


@query("noise_filter", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= greatest(4.0, 1000 * 1500 * 2e-6::DOUBLE) AND l_quantity * 20 <= 600 AND l_linenumber <= 900")
def _noise(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity") * 20).alias("w"), F.col("l_linenumber").alias("h"), F.col("l_quantity").alias("area"), F.lit(1000).alias("page_w"), F.lit(1500).alias("page_h"))
    return records.noise_free(rows).select("l_orderkey", "l_partkey")


@query("geometric_garbage", "SELECT p_partkey, p_size / 50.0::DOUBLE < 0.32 OR p_partkey % 100 / 100.0::DOUBLE < 0.55 AS garbage FROM part")
def _garbage(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", records.geometric_garbage(F.col("p_size") / 50.0, F.pmod("p_partkey", F.lit(100)) / 100.0).alias("garbage"))


_CUR = f"(SELECT id, substr('abcdefgh', id % 8 + 1, 1) AS char, tier, score / 5 AS p, substr('abcdefgh', id // 8 % 8 + 1, 1) AS top FROM {_PART})"


@query("auto_curate", f"""SELECT id, CASE WHEN low THEN 'Bronze' ELSE tier END AS tier, low AS demoted FROM (SELECT *, j AND count(*) OVER (PARTITION BY char, j) >= 2 AND row_number() OVER (PARTITION BY char, j ORDER BY p DESC, id) > 1 AND p < 0.05 AND top <> char AS low FROM (SELECT *, tier IN ('Gold', 'Silver') AS j FROM {_CUR}))""")
def _curate(spark, sf_dir):
    letters = F.array(*[F.lit(c) for c in "abcdefgh"])
    rows = entries(spark, sf_dir).select("id", F.element_at(letters, (F.col("id") % 8 + 1).cast("int")).alias("char"), "tier", (F.col("score") / 5).alias("p"), F.element_at(letters, (F.floor(F.col("id") / 8) % 8 + 1).cast("int")).alias("top"))
    return records.auto_curate(rows).select("id", "tier", "demoted")


@query("session_stats", f"SELECT count(*) AS total, count(*) FILTER (WHERE id % 3 = 0) AS approved, count(*) FILTER (WHERE id % 3 = 1) AS rejected, count(*) FILTER (WHERE id % 3 = 2) AS pending, count(*) FILTER (WHERE score < 0.7 OR tier = 'Bronze') AS to_review FROM {_PART}")
def _session(spark, sf_dir):
    return records.session_stats(entries(spark, sf_dir).select(F.element_at(F.array(F.lit("approved"), F.lit("rejected"), F.lit("pending")), (F.col("id") % 3 + 1).cast("int")).alias("decision"), F.col("score").alias("conf"), "tier"))


@query("score_deciles", f"SELECT (floor(round(score * 100) / 10) * 10)::BIGINT AS decile, count(*) AS n FROM {_PART} GROUP BY 1")
def _deciles(spark, sf_dir):
    return records.deciles(entries(spark, sf_dir).withColumn("s", F.round(F.col("score") * 100)), "s")


@query("mean_of_known", "SELECT round(avg(quality), 4) AS quality, round(avg(CASE WHEN quality = 1 THEN toxic END), 4) AS toxic FROM labels")
def _mean(spark, sf_dir):
    return records.mean_of_known(table(spark, sf_dir, "labels").select("quality", F.when(F.col("quality") == 1, F.col("toxic")).alias("toxic")), ["quality", "toxic"])


@query("reference_em", "SELECT p_brand AS profile, round(coalesce(x, a), 4) AS x_height, round(2.1::DOUBLE * coalesce(x, a), 4) AS em FROM (SELECT p_brand, median(CASE WHEN p_type = 'SMALL' THEN p_retailprice END) AS x FROM part GROUP BY 1), (SELECT median(CASE WHEN p_type = 'SMALL' THEN p_retailprice END) AS a FROM part)")
def _em(spark, sf_dir):
    rows = parts(spark, sf_dir).select(F.col("p_brand").alias("profile"), F.col("p_retailprice").alias("height"), "p_type")
    return records.reference_em(rows, F.col("p_type") == "SMALL", 2.1).withColumn("x_height", F.round("x_height", 4))


@query("advance_width", "SELECT char, round(least(greatest(coalesce(avg(CASE WHEN em > 0 AND width > 0 THEN width::DOUBLE / em END), 0.5), 0.05), 2.0) + 0.08, 6) AS advance FROM (SELECT p_brand AS char, p_size - 5 AS width, p_partkey % 60 AS em, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 8 GROUP BY 1")
def _advance(spark, sf_dir):
    rows = parts(spark, sf_dir).select(F.col("p_brand").alias("char"), F.col("p_partkey").alias("id"), (F.col("p_size") - 5).alias("width"), (F.col("p_partkey") % 60).alias("em"))
    return records.advance(rows).withColumn("advance", F.round("advance", 6))


@query("corrected_em", "SELECT id, char, old, new FROM (SELECT p_partkey AS id, p_type AS char, p_size AS old, least(greatest(round_even(p_size / CASE p_type WHEN 'SMALL' THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END, 0), 40), 400)::INTEGER AS new FROM part WHERE p_type IN ('SMALL', 'ECONOMY') AND p_size > 0) WHERE old <> new")
def _corrected(spark, sf_dir):
    rows = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_type").alias("char"), F.col("p_size").alias("height"), F.col("p_size").alias("em"))
    return records.corrected_em(rows, {"SMALL": 0.25, "ECONOMY": 0.1})


@query("set_by_key", "SELECT p_partkey, CASE WHEN p_partkey IN (SELECT s_suppkey FROM supplier) THEN 'approved' ELSE p_type END AS p_type FROM part")
def _set(spark, sf_dir):
    return records.set_column(parts(spark, sf_dir).select("p_partkey", "p_type"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey")), "p_partkey", "p_type", F.lit("approved"))


@query("trash_cycle", "SELECT o_orderkey FROM orders WHERE NOT (o_custkey % 5 = 0 AND o_custkey % 10 <> 0 AND o_orderdate < TIMESTAMP '1996-01-01')")
def _trash(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    gone = records.trashed(o, o.where("o_custkey % 5 = 0"), "o_orderkey", F.col("o_orderdate"))
    return records.emptied(records.restored(gone, o.where("o_custkey % 10 = 0"), "o_orderkey"), F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("moved_paths", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'http:/' || '/' || substr(url, 9) ELSE url END AS url FROM pages")
def _paths(spark, sf_dir):
    return records.moved_paths(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "https:/", "http:/")


@query("backfilled", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(sha1(coalesce(text, '')), 1, 6) ELSE source END AS key FROM documents")
def _backfill(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("key"))
    return records.backfilled(rows, F.substring(F.sha1(F.coalesce("text", F.lit("")).cast("binary")), 1, 6), "key").select("doc_id", "key")


@query("union_precedence", "SELECT s_suppkey AS k, 'supplier' AS src FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _precedence(spark, sf_dir):
    side = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("k"), F.lit(name).alias("src"))
    return records.with_precedence([side("supplier", "s_suppkey"), side("customer", "c_custkey")], "k")


@query("geometry_groups", "SELECT p_size AS cols, p_partkey % 5 AS rows, count(*) AS n, min(p_name) AS first FROM part GROUP BY 1, 2")
def _geometry(spark, sf_dir):
    return records.geometries(parts(spark, sf_dir).select(F.col("p_size").alias("cols"), (F.col("p_partkey") % 5).alias("rows"), F.col("p_name").alias("name")))


@query("circular_neighbours", "SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER w, min(o_orderkey) OVER (PARTITION BY o_custkey)) AS next, coalesce(lag(o_orderkey) OVER w, max(o_orderkey) OVER (PARTITION BY o_custkey)) AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _ring(spark, sf_dir):
    return records.neighbours(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("recent_projects", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 6")
def _recent(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(6)


@query("balanced_pages", "SELECT user_id, event_id, CASE WHEN k < more * (small + 1) THEN k // (small + 1) ELSE more + (k - more * (small + 1)) // small END::INTEGER AS page FROM (SELECT *, n // pages AS small, n % pages AS more FROM (SELECT *, ceil(n / 7.0)::BIGINT AS pages FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)))")
def _pages(spark, sf_dir):
    return records.balanced_pages(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 7)


@query("merged_stacks")
def _stacks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = (F.col("event_id") % 211).cast("long")
    box = F.struct(x.alias("x0"), (F.col("event_id") % 13).cast("long").alias("y0"), (x + 9).alias("x1"), (F.col("event_id") % 13 + 8).cast("long").alias("y1"))
    by = e.groupBy("user_id").agg(F.array_sort(F.collect_list(box)).alias("b"))
    return by.select("user_id", records.merged_stacks(F.col("b")).alias("merged"))


@query("mass_cuts", "SELECT user_id, part, min(event_id) AS cut FROM (SELECT user_id, event_id, sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS r, sum(event_id % 7) OVER (PARTITION BY user_id) AS t FROM events), (SELECT unnest([1, 2, 3])::INTEGER AS part) WHERE r >= t * part / 4.0::DOUBLE GROUP BY 1, 2")
def _cuts(spark, sf_dir):
    return records.mass_cuts(table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7).alias("m")), "user_id", "event_id", "m", 4)


@query("grid_dims")
def _grid(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    by = lambda k: e.groupBy("event_type", F.floor(F.unix_timestamp("ts") / (3600 * k)).alias("pos")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return records.grid_dims(by(1), by(2), "event_type", "pos", "value")


@query("structure_score", "SELECT l_suppkey, round(CASE WHEN count(*) FILTER (WHERE l_discount > 0) > 0 THEN (count(*) FILTER (WHERE l_discount > 0 AND l_linenumber <= 3) - 0.5::DOUBLE * count(*) FILTER (WHERE l_discount > 0 AND l_linenumber > 3)) / count(*) FILTER (WHERE l_discount > 0) ELSE 0 END, 6)::DOUBLE AS score FROM lineitem GROUP BY 1")
def _score(spark, sf_dir):
    return records.structure_score(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_discount").alias("ink"), F.col("l_linenumber").alias("parts")), "l_suppkey")


@query("chosen_variant")
def _variant(spark, sf_dir):
    return records.chosen_variant(entries(spark, sf_dir).withColumn("degenerate", F.col("misread")))


@query("merged_chains")
def _chains(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return records.merged_chains(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("a"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey") + 1).otherwise(-F.col("o_orderkey") - 1).alias("b")))


@query("diagram_tokens", r"SELECT conv_id, turn, lower(w[1]) AS command, len(w)::INTEGER - 1 AS n_args FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM conversations)")
def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", records.diagram_tokens(F.col("text")).alias("t")).select("conv_id", "turn", F.col("t.command").alias("command"), F.size("t.args").alias("n_args"))


@query("import_cost", "SELECT conv_id, round(count(*) * CASE conv_id % 3 WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 4.0::DOUBLE ELSE 8.0::DOUBLE END, 2) AS seconds FROM conversations GROUP BY conv_id")
def _cost(spark, sf_dir):
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("conv_id", records.import_cost(F.when(F.col("conv_id") % 3 == 0, "text").when(F.col("conv_id") % 3 == 1, "mixed").otherwise("other"), F.col("n")).alias("seconds"))


@query("label_maps", "SELECT vec_id, CASE WHEN vec_id % 30 < 26 THEN chr((vec_id % 30 + 97)::INTEGER) ELSE '?' END AS char, CASE WHEN vec_id % 30 < 26 THEN (vec_id % 30)::INTEGER END AS label FROM embeddings")
def _labels(spark, sf_dir):
    char = records.char_of((F.col("vec_id") % 30).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", char.alias("char"), records.label_of(char).alias("label"))
