"""Arithmetic on line boxes (arrays of four points, or the columns x0, x1, y0, y1 made from them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_extents(lines: DataFrame) -> DataFrame:
    """Adds x0, x1, y0, y1, cy (centre), h (height) and thickness (the smaller extent, 1 at least)."""
    xs, ys = F.transform("box", lambda p: p["x"]), F.transform("box", lambda p: p["y"])
    out = lines.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys), "cy": F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / 4})
    return out.withColumn("h", F.col("y1") - F.col("y0")).withColumn("thickness", F.greatest(F.lit(1.0), F.least(F.col("x1") - F.col("x0"), F.col("h"))))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def column_overlap(a: str, b: str) -> Column:
    """Shared share of the narrower of two lines across the reading direction; 0 for an upright and a sideways one."""
    c = lambda side, name: F.col(f"{side}.{name}")
    tall = lambda s: (c(s, "y1") - c(s, "y0")) > (c(s, "x1") - c(s, "x0"))
    along = lambda lo, hi: overlap(c(a, lo), c(a, hi), c(b, lo), c(b, hi)) / F.greatest(F.lit(1.0), F.least(c(a, hi) - c(a, lo), c(b, hi) - c(b, lo)))
    return F.when(tall(a) != tall(b), 0.0).when(tall(a), along("y0", "y1")).otherwise(along("x0", "x1"))


def area_overlap(a: str, b: str) -> Column:
    """Shared share of the smaller of two boxes."""
    c = lambda side, name: F.col(f"{side}.{name}")
    shared = overlap(c(a, "x0"), c(a, "x1"), c(b, "x0"), c(b, "x1")) * overlap(c(a, "y0"), c(a, "y1"), c(b, "y0"), c(b, "y1"))
    size = lambda s: (c(s, "x1") - c(s, "x0")) * (c(s, "y1") - c(s, "y0"))
    return shared / F.greatest(F.lit(1.0), F.least(size(a), size(b)))


def to_upright(x: Column, y: Column, degrees: Column, width: Column, height: Column, scale: Column) -> Column:
    """A point read on a turned, shrunk image, back on the upright full-size image of this width and height."""
    px = F.when(degrees == 90, y).when(degrees == 180, width * scale - x).when(degrees == 270, width * scale - y).otherwise(x)
    py = F.when(degrees == 90, height * scale - x).when(degrees == 180, height * scale - y).when(degrees == 270, x).otherwise(y)
    return F.struct(F.bround(px / scale, 1).alias("x"), F.bround(py / scale, 1).alias("y"))


def evidence_box(evidence: Column, width: Column, height: Column, pad: int = 8) -> Column:
    """Box around all evidence on the first piece's image, padded and held within the image."""
    first = F.get(evidence, F.lit(0))["image_index"]
    points = F.flatten(F.transform(F.filter(evidence, lambda e: e["image_index"] == first), lambda e: e["box"]))
    side = lambda f, name: f(F.transform(points, lambda p: p[name]))
    zero = F.lit(0.0)
    return F.when(F.size(evidence) > 0, F.struct(first.alias("image_index"), F.greatest(zero, side(F.array_min, "x") - pad).alias("x0"), F.greatest(zero, side(F.array_min, "y") - pad).alias("y0"), F.least(width.cast("double"), side(F.array_max, "x") + pad).alias("x1"), F.least(height.cast("double"), side(F.array_max, "y") + pad).alias("y1")))
