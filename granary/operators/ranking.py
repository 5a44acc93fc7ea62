"""Fuzzy ranks and top classes by built-in functions; text ratios, sampling and routes, which these cannot say, in Arrow batches."""

from __future__ import annotations

import difflib
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points of a fuzzy match, its separators and its limit.
CHAR, WORD_START, CONSECUTIVE, PREFIX, KEYWORDS, EMPTY, MOST = 1.0, 2.0, 1.5, 2.0, 0.8, 1.0, 8
SEPARATORS = " \t_-./:·"
WEIGHTS = {"Gold": 3, "Silver": 1, "Bronze": 0}


def fuzzy_score(query: str, text: Column) -> Column:
    """How well the query's characters are found in order in a text, the best over all places of the first of them.

    Each character counts, more after a separator and next to the one before; a text that begins with the query
    gets more for each character. 0 if one is missing or the text is null; an empty query finds every text alike.
    """
    query, text = query.lower().strip(), F.lower(F.coalesce(text, F.lit("")))
    if not query:
        return F.lit(EMPTY)
    starts = [F.lit(""), *map(F.lit, SEPARATORS)]
    at_start = lambda at: F.when(F.substring(text, at - 1, F.when(at > 1, 1).otherwise(0)).isin(*starts), WORD_START).otherwise(0.0)
    # A way is the place reached (0: none) and its points; it starts at each place and goes on to the next fitting character.
    ways = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.struct(F.when(F.substring(text, i, F.lit(1)) == query[0], i).otherwise(0).alias("at"), (CHAR + at_start(i)).alias("points")))
    for c in query[1:]:
        ways = F.transform(F.filter(ways, lambda w: w["at"] > 0), _onward(text, c, at_start))
    best = F.coalesce(F.array_max(F.transform(F.filter(ways, lambda w: w["at"] > 0), lambda w: w["points"])), F.lit(0.0))
    return best + F.when((best > 0) & text.startswith(query), PREFIX * len(query)).otherwise(0.0)


def _onward(text: Column, c: str, at_start: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def step(way: Column) -> Column:
        at = F.call_function("locate", F.lit(c), text, way["at"] + 1)
        return F.struct(at.alias("at"), (way["points"] + CHAR + at_start(at) + F.when(at == way["at"] + 1, CONSECUTIVE).otherwise(0.0)).alias("points"))

    return step


def fuzzy_rank(rows: DataFrame, query: str, most: int = MOST) -> DataFrame:
    """(id, ord, label, score): the best matches of label or keywords, without those that do not match. An empty query takes all rows in order."""
    if not query.strip():
        return rows.select("id", "ord", "label", F.lit(EMPTY).alias("score")).orderBy("ord")
    score = F.greatest(fuzzy_score(query, F.col("label")), KEYWORDS * fuzzy_score(query, F.col("keywords")))
    found = rows.select("id", "ord", "label", score.alias("score")).where("score > 0")
    return found.orderBy(F.desc("score"), "ord").limit(most)


def similarity(a: Column, b: Column) -> Column:
    """The ratio of matching blocks of two texts, in lower case with single spaces."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        plain = lambda t: " ".join((t or "").lower().split())
        return pd.Series([difflib.SequenceMatcher(None, plain(p), plain(q), autojunk=False).ratio() for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def sample_variants(rows: DataFrame, wanted: DataFrame, seed: int = 42) -> DataFrame:
    """(char, turn, id): a variant for each turn of a character, drawn by tier (3, 1, 0) from those not used in the last
    min(3, n - 1) turns. Only variants of weight 0 are drawn evenly. Seeded by character, so a rerun draws the same."""

    def run(key: tuple, variants: pd.DataFrame, turns: pd.DataFrame) -> pd.DataFrame:
        if variants.empty or turns.empty:
            return pd.DataFrame([], columns=["char", "turn", "id"])
        rng, variants = random.Random(f"{seed}/{key[0]}"), variants.sort_values("id")
        ids, tiers = variants["id"].tolist(), variants["tier"].tolist()
        weight = [WEIGHTS.get(t, 0) for t in tiers]
        if not any(weight):
            weight = [1] * len(ids)
        out, used = [], []
        for turn in sorted(turns["turn"].tolist()):
            recent = set(used[-min(3, len(ids) - 1) :]) if len(ids) > 1 else set()
            free = [(i, w) for i, w in zip(ids, weight, strict=True) if i not in recent and w] or [(i, 1) for i in ids if i not in recent]
            pick = rng.choices([i for i, _ in free], [w for _, w in free])[0]
            used.append(pick)
            out.append((key[0], turn, pick))
        return pd.DataFrame(out, columns=["char", "turn", "id"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("char", "id", "tier").groupBy("char").cogroup(wanted.select("char", "turn").groupBy("char")).applyInPandas(run, f"char string, turn long, id {kind}")


def nearest_route(strokes: DataFrame) -> DataFrame:
    """(page, stroke, ord, reversed): strokes (x0, y0, x1, y1) in the order of a pen that always takes the nearest free end."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {r.stroke: (r.x0, r.y0, r.x1, r.y1) for r in pdf.sort_values("stroke").itertuples()}
        x = y = 0.0
        out = []
        while left:
            _, back, s = min(((e - x) ** 2 + (f - y) ** 2, flip, k) for k, v in left.items() for flip, (e, f) in ((False, v[:2]), (True, v[2:])))
            x0, y0, x1, y1 = left.pop(s)
            x, y = (x0, y0) if back else (x1, y1)
            out.append((pdf["page"].iloc[0], s, len(out), back))
        return pd.DataFrame(out, columns=["page", "stroke", "ord", "reversed"])

    return strokes.groupBy("page").applyInPandas(run, "page long, stroke long, ord int, reversed boolean")


def top_classes(probabilities: Column, k: int) -> Column:
    """The k most probable classes with their probabilities after softmax of the scores; of equals the lower class."""
    top = F.array_max(probabilities)
    powers = F.transform(probabilities, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    ranked = F.array_sort(F.transform(powers, lambda p, i: F.struct((-p / total).alias("n"), i.alias("class"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s["class"].alias("class"), (-s["n"]).alias("p")))
