"""Column functions of geometry: units, grids, slants, and options derived from measured statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MM_PER_INCH = 25.4


def to_pixels(mm: Column, dpi: Column | int) -> Column:
    return F.bround(mm * dpi / MM_PER_INCH).cast("int")


def to_mm(pixels: Column, dpi: Column | int) -> Column:
    return pixels * MM_PER_INCH / dpi


def grid_rect(index: Column, columns: int, left: int, top: int, width: int, height: int) -> Column:
    """The box of the cell with an index, counted along the rows."""
    row, column = F.floor(index / columns).cast("int"), F.pmod(index, F.lit(columns)).cast("int")
    return F.struct(row.alias("row"), column.alias("col"), (left + column * width).alias("x"), (top + row * height).alias("y"), F.lit(width).alias("w"), F.lit(height).alias("h"))


def slant(x: Column, y: Column) -> Column:
    """An aggregate: degrees by which points lean, from the moments of x and y; 0 for points on one height."""
    return F.when(F.var_pop(y) > 0, F.degrees(F.atan(F.covar_pop(x, y) / F.var_pop(y)))).otherwise(0.0)


def options_of(metrics: dict[str, Column], limits: dict[str, tuple[float, float, float]]) -> Column:
    """Options from metrics: each by a factor and held within (factor, low, high); a metric without a value gives the low end."""
    return F.struct(*[F.least(F.greatest(F.coalesce(metrics[k] * f, F.lit(low)), F.lit(low)), F.lit(high)).alias(k) for k, (f, low, high) in limits.items()])


def snapshot(source: Column, now: Column, **metrics: Column) -> Column:
    """Metrics with their provenance, as JSON."""
    return F.to_json(F.struct(source.alias("source"), now.cast("string").alias("taken_at"), F.struct(*[v.alias(k) for k, v in metrics.items()]).alias("metrics")))
