"""Several readings of one image: the best orientation, lines adopted from another reading, and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import area_overlap, with_extents

LOW_CONFIDENCE, FEW_LINES, BETTER = 0.80, 3, 1.15


def best_read(reads: DataFrame) -> DataFrame:
    """From lines (image, degrees, confidence) read at 0, 90 and 270 degrees: image, chosen, score.

    The upright reading stays unless it is poor (mean confidence under 0.8 or fewer than three lines). A turned one is
    then chosen if its score, the sum of confidences of 0.5 and more, is over 1.15 times that of the one chosen so
    far; 90 degrees are tried first. An image with no line at 0 has a poor upright reading of score 0.
    """
    at = lambda d: F.coalesce(F.sum(F.when((F.col("degrees") == d) & (F.col("confidence") >= 0.5), F.col("confidence"))), F.lit(0.0)).alias(f"s{d}")
    upright = F.when(F.col("degrees") == 0, F.col("confidence"))
    per = reads.groupBy("image").agg(at(0), at(90), at(270), F.coalesce(F.avg(upright), F.lit(0.0)).alias("mean"), F.count(upright).alias("n"))
    poor = (F.col("mean") < LOW_CONFIDENCE) | (F.col("n") < FEW_LINES)
    first = F.struct(F.lit(0).alias("chosen"), F.col("s0").alias("score"))
    second = F.when(poor & (F.col("s90") > F.col("s0") * BETTER), F.struct(F.lit(90).alias("chosen"), F.col("s90").alias("score"))).otherwise(first)
    third = F.when(poor & (F.col("s270") > F.col("best.score") * BETTER), F.struct(F.lit(270).alias("chosen"), F.col("s270").alias("score"))).otherwise(F.col("best"))
    return per.withColumn("best", second).withColumn("best", third).select("image", "best.chosen", "best.score")


def adopted(lines: DataFrame, better: DataFrame) -> DataFrame:
    """Lines (item_id, image_index, line_seq, box, ...) with those of a better reading in the place of what they cover:
    a line that shares more than half of the smaller box with one of them goes. Both tables have the same columns."""
    key = ["item_id", "image_index"]
    sides = ["x0", "x1", "y0", "y1"]
    new = with_extents(better).select(*key, F.struct(*sides).alias("b"))
    old = with_extents(lines).select(*key, "line_seq", F.struct(*sides).alias("a"))
    covered = old.join(new, key).where(area_overlap("a", "b") > 0.5).select(*key, "line_seq").distinct()
    return lines.join(covered, [*key, "line_seq"], "left_anti").select(*lines.columns).unionByName(better)


def timing(images: DataFrame) -> DataFrame:
    """From (item_id, image_index, queue_ms, ocr_ms): the longest wait and the reading times in order, an item each."""
    times = F.transform(F.array_sort(F.collect_list(F.struct("image_index", "ocr_ms"))), lambda x: x["ocr_ms"])
    return images.groupBy("item_id").agg(F.coalesce(F.max("queue_ms"), F.lit(0)).alias("queue_ms"), times.alias("ocr_ms"))
