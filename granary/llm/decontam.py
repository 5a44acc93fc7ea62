"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows.

DataFrame functions only, in one pass over the documents. A window of n words anywhere in a text holds
a whole block of k = (n + 1) // 2 words that starts at a multiple of k, so a text is first scanned by
its aligned blocks alone: their hashes are looked up in the hash set of all k-grams of the windows.
Around the few hits the windows themselves are looked up by hash and then compared word by word. A
closing sentinel block makes every document come out of the lookups, so neither a second scan nor a
join back is needed; only sentinels and hits are shuffled. The hash sets are broadcast while the
benchmark has at most ``broadcast_windows`` windows (10 words, so about 400 bytes each). Beyond that
the same lookups run as shuffled joins, of blocks' hashes and places first, then of the windows around the
hits; no document's words travel with either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, with_marks

WINDOW = 10
_SENTINEL = 0
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case. ``lower`` does just that on ASCII texts and is much faster than ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def norm_words(text: Column) -> Column:
    """Runs of digits, lower-case letters and everything beyond ASCII; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SPLIT), "")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per distinct window: ``h``, its number of words, the words, and the ids of the items that hold it.

    An item of fewer words than ``size`` is one window; null and wordless items have none; null ids name no item.
    """
    items = benchmark.select(benchmark[id_col].alias("item"), norm_words(benchmark[text_col]).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("gram"))
    return each.groupBy("gram").agg(F.collect_set("item").alias("items")).select(F.xxhash64("gram").alias("h"), F.size("gram").alias("len"), "gram", "items")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = WINDOW, broadcast_windows: int = 1_000_000, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``hits`` (array of word ranges, sorted, end exclusive),
    ``n_hit`` words inside any hit, and ``items`` (ids as text, sorted as text); ``keep`` names columns to carry along.

    Null or wordless texts have no hits. Repeated rows, also of one id, stay separate rows. An empty
    benchmark gives no hits. Only the columns named are read.
    """
    windows = benchmark_windows(benchmark, item_col, item_text_col, size)
    known = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    lengths = sorted(known, reverse=True)
    block = {n: (n + 1) // 2 for n in lengths}
    no_longs, no_words = F.array().cast("array<long>"), F.array().cast("array<string>")
    spark = docs.sparkSession
    k = F.floor((F.col("len") + 1) / 2).cast("int")
    parts = windows.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("len") - k + 1), lambda i: F.xxhash64("len", F.slice("gram", i, k)))).alias("b"))
    end = spark.range(1).select(F.lit(_SENTINEL).cast("long").alias("h"), F.lit(0).alias("len"), no_words.alias("gram"), F.array().cast(windows.schema["items"].dataType).alias("items"))
    shuffled = sum(known.values()) > broadcast_windows
    table = windows if shuffled else F.broadcast(windows.unionByName(end))
    parts = parts.distinct() if shuffled else F.broadcast(parts.union(end.select("h")).distinct())

    def hashes(n: int) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.col("_n") / block[n]).cast("int") - 1)
        return F.when(F.col("_n") >= n, F.transform(blocks, lambda m: F.xxhash64(F.lit(n), F.slice("_w", m * block[n] + 1, block[n])))).otherwise(no_longs)

    kept_struct = F.struct(docs[id_col].alias("id"), *[docs[c].alias(f"k{i}") for i, c in enumerate(keep)])
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), kept_struct.alias("_kept"), norm_words(docs[text_col]).alias("_w"))
    if shuffled:
        rows = materialise(rows)
    rows = rows.withColumn("_n", F.size("_w"))
    carried = ["_row", "_n"] if shuffled else ["_row", "_kept", "_w", "_n"]
    last_block = [] if shuffled else [F.array(F.lit(_SENTINEL).cast("long"))]
    blocks = rows.select(*carried, F.concat(no_longs, *map(hashes, lengths), *last_block).alias("_b"))
    # The outer form keeps the optimizer from computing the hashes a second time to filter empty arrays; with sentinels there are none.
    near = blocks.select(*carried, F.posexplode_outer("_b").alias("_pos", "b")).join(parts, "b", "left_semi")
    # Which length a block is for, and its number: its place in the array less the places of longer windows' blocks.
    length, number, before = F.lit(0), F.lit(0), F.lit(0)
    for n in lengths:
        count = F.when(F.col("_n") >= n, F.floor(F.col("_n") / block[n]).cast("int")).otherwise(0)
        here = (F.col("_pos") >= before) & (F.col("_pos") < before + count)
        length, number = F.when(here, n).otherwise(length), F.when(here, (F.col("_pos") - before) * block[n]).otherwise(number)
        before = before + count
    near = near.select(*carried, length.alias("_len"), number.alias("_block"))
    size_of_block = F.floor((F.col("_len") + 1) / 2).cast("int")
    first = F.greatest(F.col("_block") + size_of_block - F.col("_len"), F.lit(0))
    last = F.least(F.col("_block"), F.col("_n") - F.col("_len"))
    around = near.withColumn("_at", F.explode_outer(F.when(F.col("_len") == 0, F.array(F.lit(0))).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    gram = F.slice("_w", F.col("_at") + 1, F.col("_len"))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["e"], x["end"]).alias("e"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["e"], x["start"]))).alias("n")),
    )["n"]
    result = [
        F.col("_doc._kept.id").alias(id_col), *[F.col(f"_doc._kept.k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_doc._n").cast("long").alias("n_words"), "hits", covered.alias("n_hit"),
        F.array_sort(F.transform(F.array_distinct("_items"), lambda x: x.cast("string"))).alias("items"),
    ]
    if shuffled:
        around = materialise(around.where(F.col("_at").isNotNull()).groupBy("_row").agg(F.collect_set(F.struct("_len", "_at")).alias("_places")))
        grams = with_marks(rows.select("_row", "_w"), around.select("_row"), "_row").join(around.hint("merge"), "_row").select("_row", "_w", F.inline("_places")).select("_row", "_at", gram.alias("gram"))
        hit = grams.withColumn("h", F.xxhash64("gram")).join(table, ["h", "gram"])
        hit = hit.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct(F.col("_at").alias("start"), (F.col("_at") + F.col("len")).alias("end")))).alias("hits"), F.flatten(F.collect_set("items")).alias("_items"))
        whole = rows.select("_row", F.struct("_kept", "_n").alias("_doc")).join(hit, "_row", "left")
        none = F.array().cast(hit.schema["hits"].dataType), F.array().cast(hit.schema["_items"].dataType)
        return whole.select("_doc", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("_items", none[1]).alias("_items")).select(*result)
    around = around.withColumn("h", F.when(F.col("_len") == 0, F.lit(_SENTINEL).cast("long")).when(F.col("_at").isNotNull(), F.xxhash64(gram)))
    hit = around.join(table, "h").where((F.col("len") == F.col("_len")) & (gram == F.col("gram")))
    real = F.col("len") > 0
    slim = hit.select(  # what is kept of the document travels with its sentinel alone
        "_row", F.when(~real, F.struct("_kept", "_n")).alias("_doc"),
        F.when(real, F.struct(F.col("_at").alias("start"), (F.col("_at") + F.col("len")).alias("end"))).alias("_hit"), F.when(real, F.col("items")).alias("_found"),
    )
    per_doc = slim.groupBy("_row").agg(F.first("_doc", ignorenulls=True).alias("_doc"), F.array_sort(F.collect_set("_hit")).alias("hits"), F.flatten(F.collect_set("_found")).alias("_items"))
    return per_doc.select(*result)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents", size: int = WINDOW, **names) -> DataFrame:
    """``docs`` without contamination, with the same columns.

    ``remove="documents"`` drops every row with a hit; ``"spans"`` keeps all rows and cuts the hit words
    out of their texts, each with the separators before it. Rows with null or clean texts stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    if remove == "documents":
        # Contamination depends on the text alone, so the scan carries a digest of it and no other column.
        texts = docs.select(F.md5(docs[text_col].cast("binary")).alias("_id"), docs[text_col].alias("_text"))
        bad = materialise(find_contamination(texts, benchmark, id_col="_id", text_col="_text", size=size, **names).where("n_hit > 0").select("_id").distinct())
        return docs.join(bad, F.md5(docs[text_col].cast("binary")) == bad["_id"], "left_anti")
    row = fresh(docs, "_granary_doc")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), docs[text_col].alias("_text"))
    found = find_contamination(packed.withColumn("_id", F.lit(0)), benchmark, id_col="_id", text_col="_text", size=size, keep=(row,), **names)
    text = F.col(f"{row}.`{text_col}`")
    words = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)
    gaps = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    with_words = found.withColumns({"_words": words, "_gaps": gaps})
    kept = F.transform("_words", lambda w, i: F.when(F.exists("hits", lambda x: (x["start"] <= i) & (i < x["end"])), F.lit("")).otherwise(F.concat(F.get("_gaps", i), w)))
    cut = F.concat(F.array_join(kept, ""), F.element_at("_gaps", -1))
    cleaned = with_words.withColumn("_cut", F.when(F.col("n_hit") > 0, cut).otherwise(text))
    return cleaned.select(*[F.col("_cut").alias(c) if c == text_col else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])
