"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

DataFrame functions only. Words and word pairs are hashed to ``BUCKETS`` buckets; two multinomials are
counted, one over the trusted documents and one over all. A document's score is the mean log ratio
of its features, so texts of any length compare; it is kept from a fixed threshold on. The table of
ratios has a fixed number of rows and is broadcast. Beside the score stand rules on the text alone:
few words, and many words in repeated windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise

BUCKETS = 1 << 16
#: Occurrences added to a feature in the target, and in proportion in the corpus, so that rare features say little.
PRIOR = 8.0
THRESHOLD = -0.12
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent
#: Trusted ids up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def buckets(rows: DataFrame, hashes: str, *kept: str) -> DataFrame:
    """A row for each word of a text: its bucket ``one``, and ``two`` of it and its neighbour (null for the last). A text without words has a row of nulls."""
    each = rows.select(*kept, hashes, F.posexplode_outer(hashes).alias("_i", "_word"))
    after = F.get(F.col(hashes), F.col("_i") + 1)
    into = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    return each.select(*kept, into(F.col("_word")).alias("one"), F.when(after.isNotNull(), into(F.xxhash64("_word", after))).alias("two"))


def with_trust(docs: DataFrame, trusted: DataFrame, id_col: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with whether their id is among the distinct ``trusted`` ids (column ``_id``)."""
    ids = trusted.where("_id IS NOT NULL").distinct().withColumn("_target", F.lit(1))
    if ids.limit(broadcast_ids + 1).count() <= broadcast_ids:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == ids["_id"], "left").drop("_id").withColumn("_target", F.coalesce("_target", F.lit(0)))


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(bucket, ratio) for every bucket that occurs: log of its share in the target over its share in the corpus, with ``PRIOR``."""
    rows = with_trust(docs.select(docs[id_col], docs[text_col]), trusted, id_col, broadcast_ids)
    rows = rows.withColumn("_x", hashed(words_of(F.col(text_col))))
    each = buckets(rows, "_x", "_target").select("_target", F.explode(F.array("one", "two")).alias("bucket"))
    counts = each.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_target").alias("target"))
    totals = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target"))
    raw, target = totals.first()
    ratio = F.log((F.col("target") + PRIOR) / (F.col("raw") * (target / max(raw, 1)) + PRIOR))
    return counts.select("bucket", (ratio if target else F.lit(0.0)).alias("ratio"))


def repeated_words(ranked: Column) -> Column:
    """Words inside windows that occur twice or more; ``ranked``: (hash, place) of all windows, sorted."""
    same = lambda x, i: (F.get(ranked, i - 1)["h"] == x["h"]) | (F.get(ranked, i + 1)["h"] == x["h"])
    places = F.array_sort(F.transform(F.filter(ranked, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("e"), F.lit(0).alias("n"))
    union = F.aggregate(places, zero, lambda a, i: F.struct((i + WINDOW).alias("e"), (a["n"] + i + WINDOW - F.greatest(a["e"], i)).alias("n")))
    return F.coalesce(union["n"], F.lit(0)).cast("long")


def quality(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``score`` (mean log ratio) and ``kept``.

    ``trusted`` has the ids of the target in its first column. A null text is an empty one: no words,
    score 0, base failed. Without trusted documents every ratio is 0, so the rules alone decide.
    Repeated rows stay; windows are compared by 64-bit hash. Only the two columns are read.
    """
    target = trusted.select(trusted[0].alias("_id"))
    table = F.broadcast(materialise(ratios(docs, target, id_col, text_col, broadcast_ids)))  # BUCKETS rows at most
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), docs[id_col].alias("_doc"), F.coalesce(docs[text_col], F.lit("")).alias("_t"))
    rows = rows.withColumn("_w", words_of(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("_row", "_doc", "_t", "_w", lines.alias("_lines"), hashed(F.col("_w")).alias("_x"))
    windows = F.when(F.size("_x") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("_x") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_x", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    rows = rows.select("_row", "_doc", "_t", "_w", "_lines", "_x", windows.alias("_h"))
    ranked = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.select("_row", "_doc", "_t", "_w", "_lines", "_x", ranked.alias("_ranked"))
    rows = rows.select(
        "_row", "_doc", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_ranked")).alias("n_repeat_words"), "_x",
    )
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    each = buckets(rows, "_x", "_row", "_doc", *base)
    for place in ("one", "two"):
        each = each.join(table.select(F.col("bucket").alias(place), F.col("ratio").alias(f"ratio_{place}")), place, "left")
    # A document's words are all in one task, so this sums them before anything is shuffled.
    ratio = F.coalesce("ratio_one", F.lit(0.0)) + F.coalesce("ratio_two", F.lit(0.0))
    n = F.greatest(F.count("one") + F.count("two"), F.lit(1))
    scored = each.groupBy("_row", "_doc", *base).agg((F.sum(ratio) / n).alias("score"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    return scored.select(F.col("_doc").alias(id_col), *base, "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
