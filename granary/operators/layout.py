"""Layout and signal statistics over ordered rows: gaps, fits, correlations, thresholds, runs, pages, wraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_stats(rows: DataFrame, key: str, pos: str, size: str) -> DataFrame:
    """By key: number of positive gaps between neighbours, the upper middle of them, and how many are wider than 2.5 times that."""
    w = Window.partitionBy(key).orderBy(pos)
    gaps = rows.withColumn("gap", F.col(pos) - F.lag(F.col(pos) + F.col(size)).over(w)).where("gap > 0")
    middle = gaps.groupBy(key).agg(F.array_sort(F.collect_list("gap")).alias("g")).select(key, F.size("g").alias("n_gaps"), F.element_at("g", F.floor(F.size("g") / 2).cast("int") + 1).alias("mid"))
    return gaps.join(middle, key).groupBy(key, "n_gaps", "mid").agg(F.count_if(F.col("gap") > 2.5 * F.col("mid")).alias("n_wide"))


def _fit(rows: DataFrame, of: list[str], x: str, y: str) -> DataFrame:
    fit = rows.groupBy(*of).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    return rows.join(fit, of).withColumn("resid", F.col(y) - F.coalesce("_s", F.lit(0.0)) * F.col(x) - F.coalesce("_i", F.lit(0.0))).drop("_s", "_i")


def baseline(rows: DataFrame, key: str, line: str, x: str, y: str, cut: float = 1.8, least: int = 4) -> DataFrame:
    """By key: the deviation and lag-1 correlation of the residuals of all its lines together. Each ``line`` of
    ``least`` points or more is fitted, and again without those beyond ``cut`` deviations if ``least`` are left."""
    of = [key, line]
    long = rows.join(rows.groupBy(*of).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n"), of)
    first = _fit(long, of, x, y)
    first = first.join(first.groupBy(*of).agg(F.stddev_pop("resid").alias("_d")), of).withColumn("_in", F.abs("resid") <= cut * F.col("_d"))
    again = (F.col("_d") > 1e-9) & (F.col("_k") >= least)
    first = first.join(first.groupBy(*of).agg(F.count_if("_in").alias("_k")), of).withColumn("_again", again).drop("_d", "_k")
    second = _fit(first.where("_again AND _in").drop("resid"), of, x, y).unionByName(first.where("NOT _again"))
    w = Window.partitionBy(*of).orderBy(x)
    pairs = second.withColumn("prev", F.lag("resid").over(w))
    top = F.coalesce(F.sum(F.col("resid") * F.col("prev")), F.lit(0.0))
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("resid").alias("sigma"), F.when(F.sum(F.pow("resid", 2)) > 0, top / F.sum(F.pow("resid", 2))).otherwise(0.0).alias("autocorr"))


def margins(rows: DataFrame, key: str, ord_: str, left: str, right: str, least: int = 3) -> DataFrame:
    """By key: lag-1 correlation of the left edge about its median, the first indent, and the variation of the right edge; zeros for few lines."""
    middle = rows.groupBy(key).agg(F.median(left).alias("_m"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(ord_)
    d = rows.join(middle, key).withColumn("d", F.col(left) - F.col("_m")).withColumn("p", F.lag("d").over(w))
    flat = F.sum(F.pow("d", 2))
    out = d.groupBy(key, "n").agg(F.when(flat > 0, F.coalesce(F.sum(F.col("d") * F.col("p")), F.lit(0.0)) / flat).otherwise(0.0).alias("a"), F.min_by("d", ord_).alias("i"), F.when(F.avg(right) != 0, F.stddev_pop(right) / F.avg(right)).otherwise(0.0).alias("c"))
    few = F.col("n") < least
    return out.select(key, *[F.when(few, 0.0).otherwise(F.col(a)).alias(b) for a, b in (("a", "margin_autocorr"), ("i", "first_indent"), ("c", "right_cv"))])


def paragraph_starts(rows: DataFrame, key: str, ord_: str, base: str, factor: float = 1.6) -> DataFrame:
    """(key, ord, starts): a line starts a paragraph if it is the first of its key, or if the step from the line above is
    more than ``factor`` times the median of the lower half of the key's steps. Keys of under three lines, or with a
    median of zero or less, have one start."""
    w = Window.partitionBy(key).orderBy(ord_)
    lines = rows.select(key, ord_, (F.col(base) - F.lag(base).over(w)).alias("step"), F.row_number().over(w).alias("line"))
    steps = lines.where("line > 1")
    ranked = steps.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("step"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    middle = ranked.where(F.col("r") <= F.greatest(F.floor(F.col("n") / 2), F.lit(1))).groupBy(key).agg(F.median("step").alias("base_step"), F.max("n").alias("n"))
    wide = (F.col("n") >= 2) & (F.col("base_step") > 0) & (F.col("step") > factor * F.col("base_step"))
    return lines.join(middle, key, "left").select(key, ord_, ((F.col("line") == 1) | F.coalesce(wide, F.lit(False))).alias("starts"))


def spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, population deviation and their ratio (0 for a mean of 0)."""
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma")).withColumn("cv", F.when(F.col("mean") != 0, F.col("sigma") / F.col("mean")).otherwise(0.0))


def otsu(rows: DataFrame, key: str, level: str) -> DataFrame:
    """(key, threshold): the level of 0 to 255 that best parts the histogram; of equals the lowest. A key has 256 rows of histogram at most."""
    h = rows.groupBy(key, F.col(level).cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    c = h.select(key, "v", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    between = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1, 2)).otherwise(0.0)
    return c.groupBy(key).agg(F.max(F.struct(F.round(between, 3).alias("b"), (-F.col("v")).alias("t"))).alias("m")).select(key, (-F.col("m.t")).alias("threshold"))


def runs(rows: DataFrame, key: str, ord_: str, flag: Column) -> DataFrame:
    """(key, start, length) of the runs of rows for which the flag holds."""
    w = Window.partitionBy(key).orderBy(ord_)
    place = rows.withColumn("_f", flag).withColumn("_n", F.row_number().over(w))
    on = place.where("_f").withColumn("_g", F.col("_n") - F.row_number().over(w))
    return on.groupBy(key, "_g").agg(F.min("_n").alias("start"), F.count(F.lit(1)).alias("length")).drop("_g")


def longest_run(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("n_runs"))


def merge_bands(bands: DataFrame, key: str, factor: float = 0.6) -> DataFrame:
    """Bands (start, length) of a key whose gap to the one before is under a share of the median length become one."""
    m = bands.groupBy(key).agg(F.median("length").alias("_m"))
    w = Window.partitionBy(key).orderBy("start")
    gap = F.col("start") - F.lag(F.col("start") + F.col("length")).over(w)
    marked = bands.join(m, key).withColumn("_new", F.coalesce(gap >= factor * F.col("_m"), F.lit(True)).cast("int")).withColumn("_g", F.sum("_new").over(w))
    return marked.groupBy(key, "_g").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length")).drop("_g")


def local_minima(rows: DataFrame, key: str, ord_: str, value: str) -> DataFrame:
    """Rows strictly below both neighbours, with their prominence: the lower of the greatest values on either side less their own."""
    w = Window.partitionBy(key).orderBy(ord_)
    before, after = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.max(value).over(w.rowsBetween(1, Window.unboundedFollowing))
    m = rows.select(key, ord_, value, F.lag(value).over(w).alias("_a"), F.lead(value).over(w).alias("_b"), before.alias("_l"), after.alias("_r"))
    return m.where((F.col(value) < F.col("_a")) & (F.col(value) < F.col("_b"))).select(key, ord_, value, (F.least("_l", "_r") - F.col(value)).alias("prominence"))


def period(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, period, strength): of the lags from a twentieth (two at least) to a third of the span the one with the best
    correlation above zero that exceeds the lag before and is not below the next; of equals the first."""
    span = rows.groupBy(key).agg((F.max(pos) - F.min(pos) + 1).alias("span"), F.avg(value).alias("m"))
    d = rows.join(span, key).withColumn("d", F.col(value) - F.col("m"))
    low, high = F.greatest(F.floor(F.col("span") / 20), F.lit(2)), F.greatest(F.floor(F.col("span") / 3), F.lit(3))
    lagged = d.select(key, F.col(pos).alias("p"), "d", F.explode(F.sequence(low - 1, high)).alias("lag"))
    other = d.select(key, F.col(pos).alias("q"), F.col("d").alias("e"))
    pairs = lagged.join(other, (lagged[key] == other[key]) & (F.col("p") + F.col("lag") == F.col("q"))).select(lagged[key], "lag", "d", "e")
    power = d.groupBy(key, "span").agg(F.sum(F.pow("d", 2)).alias("z"))
    corr = pairs.groupBy(key, "lag").agg(F.sum(F.col("d") * F.col("e")).alias("c")).join(power, key).select(key, "lag", "span", F.round(F.col("c") / F.col("z"), 9).alias("r"))
    w = Window.partitionBy(key).orderBy("lag")
    peaks = corr.withColumn("a", F.lag("r").over(w)).withColumn("b", F.lead("r").over(w)).where((F.col("r") > F.col("a")) & (F.col("r") >= F.col("b")) & (F.col("r") > 0) & (F.col("lag") >= low) & (F.col("lag") < high))
    return peaks.groupBy(key).agg(F.max_by("lag", F.struct(F.col("r"), -F.col("lag"))).alias("period"), F.max("r").alias("strength"))


def paginate(rows: DataFrame, key: str, ord_: str, usable: int, spacing: int) -> DataFrame:
    """Rows with the page they fall on, as many to a page as the spacing allows, and their place on it."""
    n = max(1, usable // spacing)
    k = F.row_number().over(Window.partitionBy(key).orderBy(ord_)) - 1
    return rows.withColumn("page", F.floor(k / n).cast("int")).withColumn("slot", F.pmod(k, F.lit(n)))


def wrapped(text: Column, width: int) -> Column:
    """The lines a text takes when words are wrapped greedily at ``width`` characters; wider words are cut with a hyphen."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    chunk = width - 1
    cut = F.flatten(F.transform(parts, lambda w: F.when(F.length(w) <= width, F.array(w)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / chunk).cast("int")), lambda i: F.concat(F.substring(w, i * chunk + 1, F.lit(chunk)), F.when((i + 1) * chunk < F.length(w), "-").otherwise(""))))))
    zero = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("line"))
    step = lambda a, w: F.when(a["line"].isNull(), F.struct(a["lines"].alias("lines"), w.alias("line"))).when(F.length(a["line"]) + 1 + F.length(w) <= width, F.struct(a["lines"].alias("lines"), F.concat_ws(" ", a["line"], w).alias("line"))).otherwise(F.struct(F.concat(a["lines"], F.array(a["line"])).alias("lines"), w.alias("line")))
    return F.aggregate(cut, zero, step, lambda a: F.when(a["line"].isNull(), a["lines"]).otherwise(F.concat(a["lines"], F.array(a["line"]))))


def flow_pages(heights: Column, page: int, grid: int, least_rows: int = 2) -> Column:
    """Pages of blocks of lines (numbers of rows) that flow down a page of ``page`` rows: each starts on the
    grid, and one that would have under ``least_rows`` rows left starts a new page. The page each starts on."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, h: Column) -> Column:
        snapped = F.ceil(a["at"] / grid).cast("int") * grid
        left = page - F.pmod(snapped, F.lit(page))
        start = F.when((left < h) & (left < least_rows), snapped + left).otherwise(snapped)
        return F.struct((start + h).cast("int").alias("at"), F.concat(a["out"], F.array(F.floor(start / page).cast("int"))).alias("out"))

    return F.aggregate(heights, zero, step, lambda a: a["out"])


def bounded_walk(noise: Column, rho: float = 0.9, bound: float = 2.0) -> Column:
    """x = rho x + e over an array of noise, held within the bound; all places."""
    zero = F.struct(F.lit(0.0).alias("x"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        x = F.least(F.greatest(rho * a["x"] + e, F.lit(-bound)), F.lit(bound))
        return F.struct(x.alias("x"), F.concat(a["out"], F.array(x)).alias("out"))

    return F.aggregate(noise, zero, step, lambda a: a["out"])
