"""Integrity of stores and telemetry: orphans, missing rows, set differences, event reports, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(files: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Files that no manifest row names."""
    return files.join(manifest.select(*keys), keys, "left_anti")


def missing(manifest: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Manifest rows without a file."""
    return manifest.join(files.select(*keys), keys, "left_anti")


def registered_only(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    return rows.join(registry.select(key), key, "left_semi")


def three_way(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, side): added, removed or kept, of the distinct keys of two lists."""
    a, b = old.select(key).distinct().withColumn("_o", F.lit(True)), new.select(key).distinct().withColumn("_n", F.lit(True))
    side = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("kept")
    return a.join(b, key, "full").select(key, side.alias("side"))


def severity(checks: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """(check, n, severity) of tables of findings: OK for none, ERROR from a limit on, else WARNING."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n", F.when(F.col("n") == 0, "OK").when(F.col("n") >= limit, "ERROR").otherwise("WARNING").alias("severity")) for name, df, limit in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def last_errors(events: DataFrame, most: int = 10) -> DataFrame:
    return events.where("category = 'error'").orderBy(F.desc("ts"), F.desc("id")).limit(most)


def slow(events: DataFrame, over: float = 500.0, most: int = 10, category: str = "timing") -> DataFrame:
    """The latest timings beyond a limit."""
    return events.where((F.col("category") == category) & (F.col("value") > over)).orderBy(F.desc("ts"), F.desc("id")).limit(most)


def frequent(events: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent category/name pairs, of equals the first seen."""
    found = events.groupBy(F.concat_ws("/", "category", "name").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return found.orderBy(F.desc("n"), "first").limit(most).select("what", "n")


def averages(events: DataFrame, category: str = "timing") -> DataFrame:
    """Mean and number of the timings of each operation."""
    return events.where((F.col("category") == category) & F.col("value").isNotNull()).groupBy("name").agg(F.round(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


def ring_buffer(events: DataFrame, size: int = 1000) -> DataFrame:
    """The latest events; a top-k, so no task sees more than that of each partition."""
    return events.orderBy(F.desc("ts"), F.desc("id")).limit(size)


def expired(rows: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """Rows with whether they are older than a time to live."""
    return rows.withColumn("expired", F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) > seconds * 1_000_000)


def trash_listing(rows: DataFrame) -> DataFrame:
    """Batches of deleted rows with size and time, the newest first; a batch without a time has that of its rows."""
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("stamp"), F.max("modified")).alias("at")).orderBy(F.desc("at"), "batch")


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def log_reasons(lines: DataFrame, pattern: str, generic: str = "other") -> DataFrame:
    """Reasons that a pattern finds in log lines (doc_id, pos, line), with counts and first places."""
    found = F.regexp_extract("line", pattern, 1)
    return lines.withColumn("reason", F.when(found == "", generic).otherwise(found)).groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def top_reason(reasons: DataFrame) -> DataFrame:
    """The most frequent reason of each log, of equals the first seen."""
    best = reasons.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "reason")).alias("b"))
    return best.select("doc_id", F.col("b.reason").alias("reason"), F.col("b.n").alias("n"))


def split_garbage(rows: DataFrame, listed: DataFrame, objective: Column, key: str) -> DataFrame:
    """Rows with whether a list or an objective rule condemns them."""
    marks = listed.select(key).distinct().withColumn("_l", F.lit(True))
    return rows.join(marks, key, "left").withColumn("purge", F.coalesce("_l", F.lit(False)) | F.coalesce(objective, F.lit(False))).drop("_l")


def page_gate(pages: DataFrame, least: float = 0.12) -> DataFrame:
    """(doc, n, mean, verdict) from page scores: suspect under ``least``; pages without any score are unknown, not low."""
    by = pages.groupBy("doc").agg(F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"))
    return by.withColumn("verdict", F.when(F.col("n") == 0, "unknown").when(F.col("mean") < least, "suspect").otherwise("ok"))


def layout_choice(candidates: DataFrame) -> DataFrame:
    """(page, layout, how) from candidates (page, layout, agreement, scored, hinted, dcols, drows, conf): the best
    agreement with five scored cells, else the hint, else the only geometry match, else the best guess as tentative."""
    best = F.max(F.when(F.col("scored") >= 5, F.struct("agreement", F.col("layout").alias("l"))))
    fits = (F.abs("dcols") <= 1) & (F.abs("drows") <= 3) & (F.col("conf") >= 0.45)
    by = candidates.groupBy("page").agg(best.alias("best"), F.min(F.when(F.col("hinted"), F.col("layout"))).alias("hint"), F.count_if(fits).alias("n_fit"), F.min(F.when(fits, F.col("layout"))).alias("fit"), F.max(F.struct("agreement", "layout")).alias("any"))
    fit = F.when(F.col("n_fit") == 1, F.col("fit"))
    how = F.when(F.col("best").isNotNull(), "agreement").when(F.col("hint").isNotNull(), "hint").when(fit.isNotNull(), "geometry").otherwise("tentative")
    return by.select("page", F.coalesce("best.l", "hint", fit, "any.layout").alias("layout"), how.alias("how"))


def versions_to_keep(files: DataFrame, most: int = 5) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("modified"), F.desc("path"))
    return files.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
