"""Column functions that grade records: tiers, quality scores, garbage and confidence rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers from the lowest, their least scores, and the weights of selection.
TIERS = ("Bronze", "Silver", "Gold")
GOLD, SILVER, REVIEW = 0.75, 0.48, 0.50
# Strict and loose duplicate thresholds by class of key.
THRESHOLDS = {"punctuation": (3, 7), "thin": (5, 10), "wide": (9, 16), "other": (7, 13)}
THIN, WIDE = "iltI1", "mw"


def tier(score: Column) -> Column:
    return F.when(score >= GOLD, "Gold").when(score >= SILVER, "Silver").otherwise("Bronze")


def verified_tier(score: Column, verified: Column) -> Column:
    """The tier, but Gold only for a verified record."""
    return F.when((score >= GOLD) & ~F.coalesce(verified, F.lit(False)), "Silver").otherwise(tier(score))


def tier_rank(name: Column) -> Column:
    """0, 1, 2 from the lowest; an unknown tier is the lowest. Case does not count."""
    return F.when(F.lower(name) == "gold", 2).when(F.lower(name) == "silver", 1).otherwise(0)


def demoted(name: Column) -> Column:
    return F.when(name == "Gold", "Silver").otherwise("Bronze")


def is_verified(consensus: Column, predicted: Column, expected: Column) -> Column:
    """Sources agree, and the first letter or digit predicted is the expected one, whatever the case."""
    first = lambda c: F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"([\p{L}\p{N}])", 1))
    return F.coalesce(consensus, F.lit(False)) & (first(predicted) != "") & (first(predicted) == first(expected))


def final_quality(base: Column, agreement: Column, confidence: Column) -> Column:
    """The base with agreement and, if there is a confidence, a bounded boost; a base below Silver cannot reach Gold."""
    boost = F.when(confidence.isNull(), 1.0).otherwise(F.least(F.greatest(1 + 0.3 * (confidence - 0.5), F.lit(0.85)), F.lit(1.10)))
    value = base * (0.7 + 0.3 * agreement) * boost
    return F.least(F.greatest(F.when(base < SILVER, F.least(value, F.lit(GOLD - 1e-6))).otherwise(value), F.lit(0.0)), F.lit(1.0))


def needs_review(confidence: Column, tier_name: Column) -> Column:
    return F.coalesce(confidence < 0.7, F.lit(True)) | (tier_name == "Bronze")


def key_class(key: Column) -> Column:
    """punctuation, thin, wide or other."""
    return F.when(key.rlike(r"^[^\p{L}\p{N}]+$"), "punctuation").when(F.instr(F.lit(THIN), key) > 0, "thin").when(F.instr(F.lit(WIDE), key) > 0, "wide").otherwise("other")


def threshold(key: Column, loose: bool = False) -> Column:
    out = F.lit(THRESHOLDS["other"][loose])
    for name in ("punctuation", "thin", "wide"):
        out = F.when(key_class(key) == name, THRESHOLDS[name][loose]).otherwise(out)
    return out


# Widths of characters, in the order they are looked up.
WIDTHS = ((".,;:!¡|`'\"", 0.28), ("iltI1íì", 0.40), ("jr", 0.50), ("fFtT", 0.60), ("scCeéèêëS", 0.63), ("nuvbpkxyzñhúùü", 0.72), ("adgqáàâ", 0.80), ("oóòôöO", 0.85), ("mwMW", 1.30))
WIDTH_UPPER, WIDTH_DIGIT, WIDTH_OTHER = 0.92, 0.73, 0.78


def width_factor(key: Column, learned: Column) -> Column:
    """The learned width of a character, else that of its class."""
    out = F.when(key.rlike(r"^\p{Lu}$"), WIDTH_UPPER).when(key.rlike(r"^\p{Nd}$"), WIDTH_DIGIT).otherwise(WIDTH_OTHER)
    for chars, width in reversed(WIDTHS):
        out = F.when(F.instr(F.lit(chars), key) > 0, width).otherwise(out)
    return F.coalesce(learned, out)


def confidence_flags(confidence: Column, aspect: Column, ink: Column, components: Column) -> Column:
    """Names of what speaks against a record."""
    return F.array_compact(F.array(F.when(confidence < 0.5, "low_confidence"), F.when((aspect < 0.2) | (aspect > 4), "odd_aspect"), F.when(ink < 0.02, "faint"), F.when(components > 3, "fragmented")))
