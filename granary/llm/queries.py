"""The registered queries of the corpus operators, each over its whole table, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder
from .decontam import find_contamination
from .langid import language_id
from .markup import extract_text
from .pieces import decode_pieces, encode_pieces
from .ppm import score_texts
from .quality import quality
from .ring import assign_shards
from .secrets import BASE, RULES, Rule, scan_secrets
from .simhash import near_duplicates
from .toxicity import score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and a digest of the base spans, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _op1_sql() -> str:
    def of(k: int, rule: Rule) -> str:
        pattern = (f"{rule.pattern[:-1]}{{{rule.least},}}" if rule.run else rule.pattern).replace("'", "''")
        if rule.ignore_case:
            pattern = f"(?i){pattern}"
        return f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, string_split_regex(t, '{pattern}') AS s, regexp_extract_all(t, '{pattern}') AS m,
            list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda g: length(g) >= {rule.least}) AS ok FROM d"""

    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({" UNION ALL ".join(of(k, r) for k, r in enumerate(RULES))}),
    each_match AS (SELECT doc_id, k, kind, unnest(s[1:len(m)]) AS before, unnest(m) AS hit, unnest(ok) AS ok, unnest(range(len(m))) AS i FROM found WHERE len(m) > 0),
    placed AS (SELECT doc_id, k, kind, ok, length(hit) AS n, sum(length(before) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM each_match),
    spans AS (SELECT doc_id, k, kind, (stop - n)::BIGINT AS a, kind || ':' || (stop - n)::BIGINT || ':' || stop::BIGINT AS span FROM placed WHERE ok),
    per_doc AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
        string_agg(span, ',' ORDER BY a, k) FILTER (WHERE kind IN ({base})) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM spans GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN per_doc USING (doc_id)"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled encoding of every document, decoded again: number of pieces, a hash of the ids, and whether the text came back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_pieces(docs).withColumns({"n_pieces": F.coalesce(F.size("ids"), F.lit(0)).cast("long"), "ids_hash": F.lower(F.hex(F.xxhash64("ids")))})
    decoded = decode_pieces(encoded).withColumns({"decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256), "n_chars": F.length("decoded").cast("long")})
    return decoded.select("doc_id", "n_pieces", "ids_hash", "n_chars", "decoded_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    found = language_id(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rules and the verdict for every document; the documents labelled good are the trusted target."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(table(spark, sf_dir, "documents"), trusted)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and byte-context scores of every document, learned from six sevenths of them."""
    return score_texts(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 24 shards of equal row counts."""
    placed = assign_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out."""
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items found."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's probabilities for every document, and its verdict."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP9_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes WHERE len(w) >= n),
windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM places),
hits AS (SELECT DISTINCT doc_id, i, a.n FROM windows a JOIN (SELECT DISTINCT n, g FROM grams) b ON a.n = b.n AND a.g = b.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM windows a JOIN grams b ON a.n = b.n AND a.g = b.g) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_sharding": op7_sharding,
    "op8_html_extraction": op8_html_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
}
ORACLES: dict[str, str] = {
    "op1_secret_scan": _op1_sql(),
    "op9_decontamination": _OP9_SQL,
}
