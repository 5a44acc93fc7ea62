"""Block queries: pages and conversations stand for documents of pages and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import blocks, study
from granary.registry import query, table

_W = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> ''))"


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")


@query("route_source", r"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'image' WHEN 4 THEN 'folder' ELSE 'text' END AS route FROM pages""")
def _route(spark, sf_dir):
    path = F.concat(F.lit("/in/a.b/x"), F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".DOCX", ".doc", ".Png", "/", ".md?x=1")]), (F.col("page_id") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", blocks.route(path).alias("route"))


@query("plain_blocks", "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS pos, 'paragraph' AS kind, text FROM (SELECT doc_id, n, trim(line, ' ') AS text FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))) WHERE text <> ''")
def _plain(spark, sf_dir):
    return blocks.plain_blocks(table(spark, sf_dir, "documents"))


@query("page_class", """SELECT conv_id AS doc_id, count(*) AS n_pages, round(avg(h), 6) AS share, CASE WHEN avg(h) >= 0.8::DOUBLE THEN 'text' WHEN avg(h) <= 1.0::DOUBLE - 0.8::DOUBLE THEN 'scan' ELSE 'mixed' END AS kind FROM (SELECT conv_id, (length(regexp_replace(text, '[ \\n\\t]', '', 'g')) >= 50)::INTEGER AS h FROM conversations) GROUP BY 1""")
def _class(spark, sf_dir):
    return blocks.page_class(turns(spark, sf_dir))


@query("page_words", f"SELECT conv_id AS doc_id, turn AS page, {_W}::INTEGER AS n_words, CASE WHEN {_W} >= 20 THEN 'text' ELSE 'scan' END AS reader FROM conversations")
def _words(spark, sf_dir):
    return blocks.page_words(turns(spark, sf_dir))


@query("document_text", f"SELECT conv_id AS doc_id, count(*) AS n_pages, sum({_W})::BIGINT AS n_words, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def _text(spark, sf_dir):
    return blocks.document_text(turns(spark, sf_dir))


# The page is cut before every block tag; a part that opens with a heading, paragraph or list item is a block.
_PARTS = rf"string_split(regexp_replace(html, '(?i)(</?(?:{blocks.BLOCK_TAGS})[\s/>])', chr(1) || '\1', 'g'), chr(1))"
_RAW = rf"(SELECT page_id AS doc_id, unnest(r) AS raw, unnest(range(len(r)))::INTEGER AS pos FROM (SELECT page_id, list_filter({_PARTS}, lambda x: regexp_matches(x, '^<(?:h[1-6]|p|li)(?:\s[^>]*)?>')) AS r FROM pages))"
_PLAIN = r"regexp_replace(regexp_replace(raw, '(?i)<br(?:[\s/][^>]*)?>', ' ', 'g'), '(?s)<!--.*?-->|</?[A-Za-z][^>]*>', '', 'g')"
_BLOCKS = rf"(SELECT doc_id, pos, CASE WHEN t LIKE 'h%' THEN 'heading' WHEN t = 'li' THEN 'list_item' ELSE 'paragraph' END AS kind, CASE WHEN t LIKE 'h%' THEN substr(t, 2, 1)::INTEGER ELSE 0 END AS level, text FROM (SELECT doc_id, pos, regexp_extract(raw, '^<(h[1-6]|p|li)', 1) AS t, trim({_PLAIN}, ' ') AS text FROM {_RAW}))"


@query("page_blocks", f"SELECT doc_id, pos, kind, level, text FROM {_BLOCKS}")
def _blocks(spark, sf_dir):
    return blocks.markup_blocks(table(spark, sf_dir, "pages"))


@query("block_headings", f"SELECT doc_id, kind, count(*) AS n FROM {_BLOCKS} GROUP BY 1, 2")
def _headings(spark, sf_dir):
    return blocks.markup_blocks(table(spark, sf_dir, "pages")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("heading_answer", f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM {_BLOCKS}),
 n AS (SELECT h.doc_id, h.pos, h.text AS heading, p.text AS answer, p.k, row_number() OVER (PARTITION BY h.doc_id, h.pos ORDER BY p.k) AS r, (SELECT min(x.k) FROM b x WHERE x.doc_id = h.doc_id AND x.kind = 'heading' AND x.k > h.k) AS stop
 FROM b h JOIN b p ON p.doc_id = h.doc_id AND p.k > h.k AND p.k <= h.k + 4 AND p.kind IN ('paragraph', 'list_item') WHERE h.kind = 'heading' AND length(h.text) <= 120 AND h.text <> '')
 SELECT doc_id, pos, heading, answer FROM n WHERE r = 1 AND answer <> '' AND (stop IS NULL OR k < stop)""")
def _answer(spark, sf_dir):
    return blocks.heading_answers(blocks.markup_blocks(table(spark, sf_dir, "pages")))


@query("block_bundles")
def _bundles(spark, sf_dir):
    return study.block_bundles(blocks.markup_blocks(table(spark, sf_dir, "pages")))


@query("block_markdown", f"SELECT doc_id, pos, CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'list_item' THEN '- ' || text ELSE text END AS md FROM {_BLOCKS}")
def _markdown(spark, sf_dir):
    return blocks.markup_blocks(table(spark, sf_dir, "pages")).select("doc_id", "pos", blocks.to_markdown(F.col("kind"), F.col("level"), F.col("text")).alias("md"))


@query("lines_of_words", """SELECT page, line::BIGINT AS line, string_agg(text, ' ' ORDER BY ord) AS text, round(avg(font), 6) AS font, CASE WHEN avg(font) >= 22 THEN 1 WHEN avg(font) >= 18 THEN 2 WHEN avg(font) >= 14 THEN 3 ELSE 0 END AS level FROM (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY ord) AS line FROM
 (SELECT user_id AS page, event_id AS ord, event_type AS text, value AS font, coalesce(abs(event_id % 17 - lag(event_id % 17) OVER (PARTITION BY user_id ORDER BY event_id)) > 5, false)::INTEGER AS n FROM events)) GROUP BY 1, 2""")
def _lines(spark, sf_dir):
    words = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("ord"), (F.col("event_id") % 17).cast("double").alias("top"), F.col("value").alias("font"), F.col("event_type").alias("text"))
    return blocks.lines_of_words(words).withColumn("font", F.round("font", 6))
