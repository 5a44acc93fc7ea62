"""The scored store: reports, coverage, review, curation, hard filters, scores, capped ranks, purge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import grades
from granary.session import use_checkpoints

# Hard filters (least box side, area shares, ink ghosts and blobs, clipping, parts, aspect), quality weights and limits.
BOX, AREA_SMALL, GHOST, GHOST_ABS, BLOB, BLOB_ABS, CLIP = 5, 0.10, 0.30, 0.03, 2.50, 0.55, 0.30
ASPECT_FACTOR, AREA_LOW, AREA_HIGH, ASPECT_LOW, ASPECT_HIGH, BIG_SIDE = 2.2, 0.25, 4.0, 0.45, 2.2, 20
WEIGHTS = {"alignment": 0.30, "binarisation": 0.20, "stroke": 0.20, "size": 0.15, "similarity": 0.15}
FLOOR, TOP, POPULATION, SURVIVORS, PASSES = 50.0, 30, 5, 3, 20
FUSE_KILLS, FUSE_RECAPTURE = 0.85, 0.40
MEASURES = ("w", "h", "area", "ink", "aspect", "edge", "parts")  # that hard filters look at


def report(rows: DataFrame) -> DataFrame:
    """(char, n, avg_score, best_tier) for each key."""
    rank = F.max(grades.tier_rank(F.col("tier")))
    best = F.element_at(F.array(*[F.lit(t) for t in grades.TIERS]), rank + 1)
    return rows.groupBy("char").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 3).alias("avg_score"), best.alias("best_tier"))


def by_tier(rows: DataFrame) -> DataFrame:
    """Rows by tier; unknown tiers are the lowest."""
    name = F.element_at(F.array(*[F.lit(t) for t in grades.TIERS]), grades.tier_rank(F.col("tier")) + 1)
    return rows.groupBy(name.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def coverage(rows: DataFrame, alphabet: list[str]) -> DataFrame:
    """One row: rows, distinct keys, how many of the alphabet are there, and the mean score."""
    have = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("char").alias("n_chars"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 3).alias("avg_score"), F.countDistinct(F.when(F.col("char").isin(alphabet), F.col("char"))).alias("n_covered"))
    return have.withColumn("n_missing", F.lit(len(set(alphabet))) - F.col("n_covered"))


def problematic(rows: DataFrame, most: int = 5, limit: float = grades.REVIEW) -> DataFrame:
    """Keys whose mean score is under ``limit``, the worst first, ``most`` of them."""
    return report(rows).where(F.col("avg_score") < limit).orderBy("avg_score", "char").limit(most)


def variants(rows: DataFrame, tier: str | None = None) -> DataFrame:
    found = rows if tier is None else rows.where(F.col("tier") == tier)
    return found.groupBy("char").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "char")


def select(rows: DataFrame, char: str | None = None, tier: str | None = None) -> DataFrame:
    """Rows of a key and a tier; None is any."""
    for column, value in (("char", char), ("tier", tier)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def review_queue(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("tier") == "Bronze") | (F.col("score") < grades.REVIEW))


def review_pages(rows: DataFrame, size: int = 40) -> DataFrame:
    """The review queue with pages of the whole queue, in order of tier, score and id.

    The queue is dealt out in ranges of that order, each sorted by one task; a row's place is its place in its
    range after the sizes of the ranges before.
    """
    use_checkpoints(rows.sparkSession)
    order = [grades.tier_rank(F.col("tier")), F.col("score"), F.col("id")]
    placed = review_queue(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("page", F.floor(place / size).cast("int")).drop("_part", "_before", "_at")


def capped(rows: DataFrame, most: int = TOP, floor: float = FLOOR, key: str = "char") -> DataFrame:
    """The best ``most`` rows of a key from a least score on."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return rows.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def curate(rows: DataFrame, cap: int = 12, keep: int = 2, floor: float = 0.50) -> DataFrame:
    """(id, char, reason, kept): classifier, quality and cap reasons in order, then the best of the
    refused are taken back until a key has ``keep`` rows."""
    first = F.when(F.col("misread"), "classifier").when(F.col("score") < floor, "quality")
    marked = rows.withColumn("reason", first)
    ok = Window.partitionBy("char", F.col("reason").isNull()).orderBy(F.desc("score"), "id")
    marked = marked.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(ok) > cap), "cap").otherwise(F.col("reason")))
    kept = F.sum(F.col("reason").isNull().cast("int")).over(Window.partitionBy("char"))
    back = Window.partitionBy("char", F.col("reason").isNull()).orderBy(F.desc("score"), "id")
    marked = marked.withColumn("n_kept", kept).withColumn("place", F.row_number().over(back))
    rescued = F.col("reason").isNotNull() & (F.col("place") <= F.greatest(F.lit(keep) - F.col("n_kept"), F.lit(0)))
    return marked.select("id", "char", "reason", (F.col("reason").isNull() | rescued).alias("kept"))


def char_stats(rows: DataFrame, key: str = "char") -> DataFrame:
    """Exact medians of the measures of a key, the most frequent number of parts (of equals the least), and the rows."""
    parts = rows.groupBy(key, "parts").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max(F.struct("n", (-F.col("parts")).alias("p"))).alias("m"))
    stats = rows.groupBy(key).agg(F.median("area").alias("med_area"), F.median("ink").alias("med_ink"), F.median("aspect").alias("med_aspect"), F.count(F.lit(1)).alias("population"))
    return stats.join(parts.select(key, (-F.col("m.p")).alias("mode_parts")), key)


def hard_reason(c: Callable[[str], Column] = F.col) -> Column:
    """The first reason against a row with its key's statistics beside it; null for none. ``c`` gives both by name."""
    many = c("population") >= POPULATION
    ghost = F.when(many, (c("ink") < GHOST * c("med_ink")) & (c("ink") < GHOST_ABS)).otherwise(c("ink") < GHOST_ABS)
    blob = F.when(many, (c("ink") > BLOB * c("med_ink")) & (c("ink") > BLOB_ABS)).otherwise((c("ink") > BLOB_ABS) & c("aspect").between(ASPECT_LOW, ASPECT_HIGH) & (F.greatest(c("w"), c("h")) >= BIG_SIDE))
    broken = F.when(c("mode_parts") == 1, c("parts") >= 3).otherwise(c("parts") > c("mode_parts") + 2)
    shape = many & ((F.greatest(c("aspect") / c("med_aspect"), c("med_aspect") / c("aspect")) > ASPECT_FACTOR) | (c("area") < AREA_LOW * c("med_area")) | (c("area") > AREA_HIGH * c("med_area")))
    return (
        F.when((F.least(c("w"), c("h")) < BOX) | (many & (c("area") < AREA_SMALL * c("med_area"))), "SPECK").when(ghost, "GHOST").when(blob, "BLOB")
        .when(c("edge") > CLIP, "CLIPPED").when(broken, "FRAGMENTED").when(shape, "OUTLIER_SHAPE")
    )


def hard_filtered(rows: DataFrame, key: str = "char") -> DataFrame:
    return rows.join(char_stats(rows, key), key).withColumn("reason", hard_reason())


def weighted_score(parts: dict[str, Column], neutral: float = 0.7, digits: int = 2) -> Column:
    """0 to 100 from components of 0 to 1; a component without a population counts as ``neutral``."""
    return F.round(100 * sum((F.lit(w) * F.when(parts[k].isNull(), neutral).otherwise(F.least(F.greatest(parts[k], F.lit(0.0)), F.lit(1.0))) for k, w in WEIGHTS.items()), F.lit(0.0)), digits)


def census(rows: DataFrame, key: str = "char") -> DataFrame:
    """Least, median and greatest of the measures of each key, and whether it has few rows."""
    each = [f(c).alias(f"{n}_{c}") for c in ("area", "ink", "aspect") for n, f in (("min", F.min), ("med", F.median), ("max", F.max))]
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *each).withColumn("deficit", F.col("n") < 10)


def _judged(alive: DataFrame, key: str) -> DataFrame:
    """The rows with ``_why``, the reason of one pass, the ``population`` of their key and their ``rank`` in it."""
    of = Window.partitionBy(key)
    stats = {"population": F.count(F.lit(1)), "mode_parts": -F.max(F.struct("_n", (-F.col("parts")).alias("p"))).over(of)["p"]} | {f"med_{c}": F.median(c) for c in ("area", "ink", "aspect")}
    stats = {name: c if name == "mode_parts" else c.over(of) for name, c in stats.items()}
    judged = alive.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "parts"))).withColumns(stats)
    judged = judged.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), "id")))
    why = F.coalesce(hard_reason(), F.when(F.col("score") < FLOOR, "LOW_SCORE").when(F.col("rank") > TOP, "LOW_RANK"))
    return judged.withColumn("_why", F.when(F.col(key).isNotNull(), why)).drop("_n", *[x for x in stats if x != "population"])  # without a key nothing is judged


def purge(rows: DataFrame, key: str = "char", passes: int = PASSES, least: int = SURVIVORS) -> DataFrame:
    """(id, alive, reason): hard filters, score floor and capped rank, again and again until a pass kills
    none, since each pass changes the medians; then keys with under ``least`` survivors get their best
    softly refused rows back.

    All rows take part in the first pass alone, as windows of their key that need one shuffle; it leaves TOP rows of a key
    at most. Only these, and then those that later passes kill, are written to the checkpoint folder."""
    from granary.session import use_checkpoints

    use_checkpoints(rows.sparkSession)

    def judge(alive: DataFrame) -> DataFrame:
        return _judged(alive, key).drop("population", "rank")

    first = judge(rows)
    if passes < 1:
        first = first.withColumn("_why", F.lit(None).cast("string"))
    later = None
    if passes > 1:
        alive = first.where(F.col("_why").isNull() & F.col(key).isNotNull()).drop("_why").checkpoint()
        for _ in range(passes - 1):
            state = judge(alive).checkpoint()
            killed = state.where("_why IS NOT NULL").select(key, "id", F.col("_why").alias("_later"))
            if not killed.take(1):
                break
            later = killed if later is None else later.unionByName(killed)
            alive = state.where("_why IS NULL").drop("_why")
    state = first.select("id", key, "score", F.col("_why").alias("reason"))
    if later is not None:
        state = state.join(later, [key, "id"], "left").withColumn("reason", F.coalesce("reason", "_later")).drop("_later")
    soft = F.col("reason").isin("LOW_SCORE", "LOW_RANK", "DUPLICATE")
    n_alive = F.sum(F.col("reason").isNull().cast("int")).over(Window.partitionBy(key))
    place = F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy(soft.desc(), F.desc("score"), "id"))
    guarded = state.withColumn("_n", n_alive).withColumn("_p", place)
    back = F.col("reason").isNotNull() & (F.col("_p") <= F.lit(least) - F.col("_n"))
    return guarded.select("id", key, "reason", (F.col("reason").isNull() | back).alias("alive"))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _hard_survivors(held: Column, passes: int) -> Column:
    """How many of the rows (an array of their measures) hard filters leave after so many passes, or once a pass kills none."""

    def median(rows: Column, name: str) -> Column:
        values = F.array_sort(F.filter(F.transform(rows, lambda x: x[name].cast("double")), lambda v: v.isNotNull()))
        middle = lambda v: F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) * 0.5 + F.get(v, F.floor(F.size(v) / 2).cast("int")) * 0.5
        return _with(values, lambda v: F.when(F.size(v) > 0, middle(v)))

    def mode(parts: Column) -> Column:
        counted = F.transform(F.array_distinct(parts), lambda p: F.struct(F.size(F.filter(parts, lambda q: q.eqNullSafe(p))).alias("n"), (-p).alias("p")))
        return -F.array_max(counted)["p"]

    def one_pass(rows: Column) -> Column:
        stats = F.struct(F.size(rows).alias("population"), mode(F.transform(rows, lambda x: x["parts"])).alias("mode_parts"), *[median(rows, c).alias(f"med_{c}") for c in ("area", "ink", "aspect")])
        of = lambda s, x: lambda name: x[name] if name in MEASURES else s[name]
        return _with(stats, lambda s: F.filter(rows, lambda x: hard_reason(of(s, x)).isNull()))

    def step(state: Column, _: Column) -> Column:
        after = _with(one_pass(state["rows"]), lambda rows: F.struct(rows.alias("rows"), (F.size(rows) == F.size(state["rows"])).alias("over")))
        return F.when(state["over"], state).otherwise(after)

    start = F.struct(held.alias("rows"), (F.size(held) == 0).alias("over"))
    return F.size(F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, step)["rows"])


def purge_counts(rows: DataFrame, key: str = "char", passes: int = PASSES, least: int = SURVIVORS) -> DataFrame:
    """(key, n, killed, kept): the rows of each key, those that ``purge`` kills, and those that no pass refuses.

    The first pass leaves TOP rows of a key at most, all from FLOOR on, so that later ones kill by hard filters alone: these
    passes run over an array in the row of the key. All rows are shuffled once, and nothing is written.
    """
    judged = _judged(rows, key)
    alive = F.col("_why").isNull() & F.col(key).isNotNull()
    held = judged.where(alive | (F.col("rank") == 1)).groupBy(key).agg(F.max("population").alias("n"), F.collect_list(F.when(alive, F.struct(*MEASURES))).alias("_held"))
    kept = F.size("_held") if passes < 2 else _hard_survivors(F.col("_held"), passes - 1)
    counted = held.select(key, "n", (F.col("n") if passes < 1 else F.when(F.col(key).isNull(), F.col("n")).otherwise(kept)).cast("long").alias("kept"))
    back = F.least(F.greatest(F.lit(least) - F.col("kept"), F.lit(0)), F.col("n") - F.col("kept"))
    return counted.select(key, "n", (F.col("n") - F.col("kept") - back).alias("killed"), "kept")


def fuses(purged: DataFrame, key: str = "char", least: int = SURVIVORS) -> DataFrame:
    """Whether a purge kills too much: its share of all rows, the share of keys left with under ``least`` rows before
    any came back, and whether one of the two is beyond its fuse."""
    return blown(purged.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("alive")).alias("killed"), F.count_if(F.col("reason").isNull()).alias("kept")), least)


def blown(by: DataFrame, least: int = SURVIVORS) -> DataFrame:
    """``fuses`` from the counts of each key."""
    kills, recapture = F.sum("killed") / F.sum("n"), F.avg((F.col("kept") < least).cast("int"))
    return by.agg(F.round(kills, 6).alias("kill_rate"), F.round(recapture, 6).alias("recapture_rate"), ((kills > FUSE_KILLS) | (recapture > FUSE_RECAPTURE)).alias("blown"))


def recent(rows: DataFrame, most: int, key: str, by: str) -> DataFrame:
    """The latest ``most`` rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by)))).where(F.col("_r") <= most).drop("_r")


def latest_per_key(rows: DataFrame, key: str, by: str) -> DataFrame:
    """One row of each key, the latest; a key seen again moves to the end of the registry."""
    return recent(rows, 1, key, by)


def fifo(rows: DataFrame, key: str, by: str, most: int = 24) -> DataFrame:
    """The ``most`` latest distinct keys of a registry."""
    return latest_per_key(rows, key, by).orderBy(F.desc(by)).limit(most)


def learned_median(samples: DataFrame, key: str = "char", least: int = 3, low: float = 0.20, high: float = 2.20) -> DataFrame:
    """The median of samples in range for keys with enough of them."""
    inside = samples.where(F.col("width").between(low, high))
    return inside.groupBy(key).agg(F.median("width").alias("median"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(key, F.least(F.greatest("median", F.lit(low)), F.lit(high)).alias("learned"), "n")


def median_normalised(rows: DataFrame, reference: Column, target: Column) -> DataFrame:
    """Rows of the target class scaled so that their median meets that of the reference class."""
    middle = rows.agg(F.median(F.when(reference, F.col("value"))).alias("_ref"), F.median(F.when(target, F.col("value"))).alias("_own"))  # one row
    return rows.crossJoin(F.broadcast(middle)).withColumn("value", F.when(target & (F.col("_own") != 0), F.col("value") * F.col("_ref") / F.col("_own")).otherwise(F.col("value"))).drop("_ref", "_own")
