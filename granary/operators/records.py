"""Smaller operators on records: gates, corrections, states, groupings, folds over ordered boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import grades
from granary.operators.layout import period

# The letters and digits a gate lets through, shape limits, the limit of a misread, and clamps.
ALLOWED = "abcdefghijklmnñopqrstuvwxyzáéíóúABCDEFGHIJKLMNÑOPQRSTUVWXYZÁÉÍÓÚ0123456789"
ASPECT, INK = (0.12, 6.0), 0.02
MISREAD, THIN_STROKE, LOOSE = 0.05, 0.32, 0.55
EM = (40, 400)
PAGE_SECONDS = {"text": 0.1, "mixed": 4.0, "scan": 8.0}


def shape_ok(w: Column, h: Column, ink: Column) -> Column:
    """Sides above zero, an aspect within limits and enough ink."""
    return F.coalesce((w > 0) & (h > 0) & (w / F.when(h != 0, h)).between(*ASPECT) & (ink >= INK), F.lit(False))


def shape_counts(boxes: DataFrame) -> DataFrame:
    """One row: kept boxes, and those dropped for their shape and for their ink."""
    c = F.col
    shape = F.coalesce((c("w") > 0) & (c("h") > 0) & (c("w") / F.when(c("h") != 0, c("h"))).between(*ASPECT), F.lit(False))
    return boxes.agg(F.count_if(shape & (c("ink") >= INK)).alias("kept"), F.count_if(~shape).alias("dropped_shape"), F.count_if(shape & (c("ink") < INK)).alias("dropped_ink"))


def gate_reason(confidence: Column, char: Column, quality: Column, least_confidence: float, least_quality: float) -> Column:
    """Why a candidate is refused: its confidence, its character, its quality, in that order; null if it is taken."""
    strange = (char != "") & (char != "?") & (F.instr(F.lit(ALLOWED), char) == 0)
    return F.when(confidence < least_confidence, "confidence").when(F.coalesce(strange, F.lit(False)), "alphabet").when(quality < least_quality, "quality")


def noise_free(boxes: DataFrame) -> DataFrame:
    """Boxes (w, h, area, page_w, page_h) that are neither specks nor lines across the page."""
    c = F.col
    return boxes.where((c("area") >= F.greatest(F.lit(4.0), c("page_w") * c("page_h") * 2e-6)) & (c("w") <= 0.6 * c("page_w")) & (c("h") <= 0.6 * c("page_h")))


def geometric_garbage(stroke: Column, solidity: Column) -> Column:
    return (stroke < THIN_STROKE) | (solidity < LOOSE)


def auto_curate(rows: DataFrame) -> DataFrame:
    """Rows (id, char, tier, p, top) with Gold and Silver ones taken down to Bronze if the chance of their own character is under
    0.05 and another comes first. The best of each character stays; characters with one scored row are left alone."""
    judged = (F.col("tier").isin("Gold", "Silver")) & F.col("p").isNotNull() & F.col("char").rlike("^[a-z]$")
    w = Window.partitionBy("char", judged)
    place = F.row_number().over(w.orderBy(F.desc("p"), "id"))
    low = judged & (F.count(F.lit(1)).over(w) >= 2) & (place > 1) & (F.col("p") < MISREAD) & (F.col("top") != F.col("char"))
    return rows.withColumn("_j", judged).withColumn("demoted", low).withColumn("tier", F.when(F.col("demoted"), "Bronze").otherwise(F.col("tier"))).drop("_j")


def session_stats(rows: DataFrame) -> DataFrame:
    """One row: candidates by decision and those in need of review."""
    n = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return rows.agg(F.count(F.lit(1)).alias("total"), n("approved"), n("rejected"), n("pending"), F.count_if(grades.needs_review(F.col("conf"), F.col("tier"))).alias("to_review"))


def deciles(rows: DataFrame, score: str) -> DataFrame:
    """(decile, n): scores of 0 to 100 by tens."""
    return rows.groupBy((F.floor(F.col(score) / 10) * 10).alias("decile")).agg(F.count(F.lit(1)).alias("n"))


def mean_of_known(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The mean of each column over the rows that have it, to four decimals; null if none has."""
    return rows.agg(*[F.round(F.avg(c), 4).alias(c) for c in columns])


def reference_em(rows: DataFrame, reference: Column, factor: float) -> DataFrame:
    """The median height of a reference class by profile, and the em derived from it (of all profiles where one has none)."""
    all_ = rows.agg(F.median(F.when(reference, F.col("height"))).alias("_all"))  # one row
    by = rows.groupBy("profile").agg(F.median(F.when(reference, F.col("height"))).alias("x_height"))
    return by.crossJoin(F.broadcast(all_)).select("profile", F.coalesce("x_height", "_all").alias("x_height"), F.round(factor * F.coalesce("x_height", "_all"), 4).alias("em"))


def advance(rows: DataFrame, most: int = 8) -> DataFrame:
    """The advance of a character in ems: the mean share of its first variants, clamped, and a gap; 0.5 without measures."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("char").orderBy("id"))).where(F.col("_n") <= most)
    share = F.avg(F.when((F.col("em") > 0) & (F.col("width") > 0), F.col("width") / F.col("em")))
    return first.groupBy("char").agg((F.least(F.greatest(F.coalesce(share, F.lit(0.5)), F.lit(0.05)), F.lit(2.0)) + 0.08).alias("advance"))


def corrected_em(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(id, char, old, new): characters with a wanted share of the em whose em changes, held within limits."""
    want = F.try_element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("char"))
    new = F.least(F.greatest(F.bround(F.col("height") / want), F.lit(EM[0])), F.lit(EM[1])).cast("int")
    return rows.where(want.isNotNull() & (F.col("height") > 0)).select("id", "char", F.col("em").alias("old"), new.alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))


def set_column(rows: DataFrame, keys: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """Rows with a new value in one column where their key is listed."""
    marks = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(marks, key, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")


def trashed(rows: DataFrame, keys: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows with the time of their deletion, which may be taken back."""
    return set_column(rows, keys, key, "deleted_at", now)


def restored(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return set_column(rows, keys, key, "deleted_at", F.lit(None))


def emptied(rows: DataFrame, before: Column) -> DataFrame:
    """Rows but for those deleted before a time."""
    return rows.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= before))


def moved_paths(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Paths under one folder written as under another."""
    return rows.withColumn(column, F.when(F.startswith(F.col(column), F.lit(f"{old}/")), F.concat(F.lit(f"{new}/"), F.substr(F.col(column), F.lit(len(old) + 2)))).otherwise(F.col(column)))


def backfilled(rows: DataFrame, computed: Column, column: str = "bits") -> DataFrame:
    """Missing or empty values computed."""
    return rows.withColumn(column, F.when(F.coalesce(column, F.lit("")) == "", computed).otherwise(F.col(column)))


def with_precedence(sources: list[DataFrame], key: str) -> DataFrame:
    """The rows of several tables, for each key those of the first table that has it."""
    out = sources[0].withColumn("_p", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("_p", F.lit(i)))
    best = out.groupBy(key).agg(F.min("_p").alias("_b"))
    return out.join(best, key).where(F.col("_p") == F.col("_b")).drop("_p", "_b")


def geometries(layouts: DataFrame) -> DataFrame:
    """(cols, rows, n, first): the distinct geometries of layouts."""
    return layouts.groupBy("cols", "rows").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


def neighbours(rows: DataFrame, key: str, ord_: str) -> DataFrame:
    """Cards with the ones before and after them in a ring."""
    w, all_ = Window.partitionBy(key).orderBy(ord_), Window.partitionBy(key)
    return rows.withColumn("next", F.coalesce(F.lead(ord_).over(w), F.min(ord_).over(all_))).withColumn("prev", F.coalesce(F.lag(ord_).over(w), F.max(ord_).over(all_)))


def balanced_pages(chars: DataFrame, key: str, ord_: str, most: int) -> DataFrame:
    """Characters dealt to as few pages of ``most`` as will do, of sizes that differ by one at most; the first pages are the larger."""
    n, k = F.count(F.lit(1)).over(Window.partitionBy(key)), F.row_number().over(Window.partitionBy(key).orderBy(ord_)) - 1
    pages = F.ceil(F.col("_n") / most)
    small, more = F.floor(F.col("_n") / pages), F.pmod(F.col("_n"), pages)
    page = F.when(F.col("_k") < more * (small + 1), F.floor(F.col("_k") / (small + 1))).otherwise(more + F.floor((F.col("_k") - more * (small + 1)) / small))
    return chars.withColumn("_n", n).withColumn("_k", k).withColumn("page", page.cast("int")).drop("_n", "_k")


def merged_stacks(lines: Column) -> Column:
    """Boxes (x0, y0, x1, y1) of a line, in order, with those that overlap the one before by half of the narrower joined to it."""
    kind = "array<struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>>"

    def step(out: Column, b: Column) -> Column:
        m = F.try_element_at(out, F.lit(-1))
        common = F.least(b["x1"], m["x1"]) - F.greatest(b["x0"], m["x0"])
        joins = F.coalesce((common > 0) & (common > 0.5 * F.least(b["x1"] - b["x0"], m["x1"] - m["x0"])), F.lit(False))
        grown = F.struct(F.least(m["x0"], b["x0"]).alias("x0"), F.least(m["y0"], b["y0"]).alias("y0"), F.greatest(m["x1"], b["x1"]).alias("x1"), F.greatest(m["y1"], b["y1"]).alias("y1"))
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(b))).cast(kind)

    return F.aggregate(lines.cast(kind), F.array().cast(kind), step)


def mass_cuts(rows: DataFrame, key: str, pos: str, mass: str, parts: int) -> DataFrame:
    """(key, part, cut): the first place where the running mass reaches each part of the whole."""
    w = Window.partitionBy(key).orderBy(pos)
    run = rows.select(key, pos, F.sum(mass).over(w).alias("_r"), F.sum(mass).over(Window.partitionBy(key)).alias("_t"))
    each = run.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts - 1)))).where(F.col("_r") >= F.col("_t") * F.col("part") / parts)
    return each.groupBy(key, "part").agg(F.min(pos).alias("cut"))


def grid_dims(columns: DataFrame, rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, cols, rows, conf): numbers of cells from the periods of two projections, and the weaker of their strengths."""
    def side(df: DataFrame, name: str) -> DataFrame:
        span = df.groupBy(key).agg((F.max(pos) - F.min(pos) + 1).alias("s"))
        return period(df, key, pos, value).join(span, key).select(key, F.bround(F.col("s") / F.col("period")).cast("int").alias(name), F.col("strength").alias(f"_{name}"))

    return side(columns, "cols").join(side(rows, "rows"), key).select(key, "cols", "rows", F.least("_cols", "_rows").alias("conf"))


def structure_score(cells: DataFrame, key: str) -> DataFrame:
    """Healthy cells less half of the crowded ones, over those with ink; 0 without ink."""
    inked = F.count_if(F.col("ink") > 0)
    score = F.when(inked > 0, (F.count_if((F.col("ink") > 0) & (F.col("parts") <= 3)) - 0.5 * F.count_if((F.col("ink") > 0) & (F.col("parts") > 3))) / inked).otherwise(0.0)
    return cells.groupBy(key).agg(F.round(score, 6).alias("score"))


def chosen_variant(rows: DataFrame, seed: int = 42) -> DataFrame:
    """(char, id): of the best tier of a character, the first in a seeded order that is not degenerate."""
    best = Window.partitionBy("char")
    ranked = rows.where("NOT degenerate").withColumn("_t", grades.tier_rank(F.col("tier"))).withColumn("_b", F.max("_t").over(best)).where("_t = _b")
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy("char").orderBy(F.xxhash64(F.lit(seed), "char", "id"), "id"))).where("_r = 1").select("char", "id")


def merged_chains(chains: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, chain): chains (id, a, b) that meet end to end at points where just two ends meet get the least id among them."""
    from granary.session import use_checkpoints

    use_checkpoints(chains.sparkSession)
    ends = chains.select("id", F.explode(F.array("a", "b")).alias("point"))
    meet = ends.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).where("n = 2 AND x <> y")
    both = meet.select("x", "y").union(meet.select(F.col("y").alias("x"), F.col("x").alias("y"))).checkpoint()
    labels, before = chains.select("id", F.col("id").alias("chain")), None
    for _ in range(most_rounds):
        pulled = both.join(labels.select(F.col("id").alias("y"), F.col("chain").alias("_c")), "y").groupBy(F.col("x").alias("id")).agg(F.min("_c").alias("_c"))
        stepped = labels.join(pulled, "id", "left").select("id", F.least("chain", F.coalesce("_c", "chain")).alias("chain"))
        jump = stepped.select(F.col("id").alias("chain"), F.col("chain").alias("_c"))
        labels = stepped.join(jump, "chain", "left").select("id", F.coalesce("_c", "chain").alias("chain")).checkpoint()
        now = labels.agg(F.sum(F.xxhash64("id", "chain").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now
    raise RuntimeError("chains did not settle")


def diagram_tokens(line: Column) -> Column:
    """A diagram line as (command, arguments): words split at spaces, the first in lower case; blank lines and notes (#) are null."""
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    return F.when((F.size(words) > 0) & ~F.trim(line).startswith("#"), F.struct(F.lower(F.get(words, F.lit(0))).alias("command"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("args")))


def import_cost(kinds: Column, pages: Column) -> Column:
    """Seconds to read a document of a kind."""
    return F.round(pages * F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PAGE_SECONDS.items() for x in kv]), kinds), F.lit(PAGE_SECONDS["scan"])), 2)


def label_of(char: Column) -> Column:
    """The class 0 to 25 of a single letter a-z in any case, else null; the other way with ``char_of``."""
    return F.when(char.rlike("^[A-Za-z]$"), F.ascii(F.lower(char)) - 97)


def char_of(label: Column) -> Column:
    return F.when(label.between(0, 25), F.char(label + 97)).otherwise("?")


def cache_size(files: DataFrame) -> DataFrame:
    """Bytes and megabytes of listed files."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1048576, 4).alias("mb"))


def options_signature(lang: str, dpi: int, handwriting: bool, pages: list[int] | None, layout: bool) -> str:
    """The options that change a result, as one text."""
    return "|".join([lang, str(dpi), str(int(handwriting)), "all" if pages is None else str(sorted(pages)), str(int(layout))])
