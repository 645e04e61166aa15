"""Reading order of lines, candidate spans, and the span that best answers a wanted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import score_texts
from ..functions.geometry import overlap, with_extents
from ..functions.text import case_only_difference, collapse_ws, fold, key

REVIEW_AT, MISMATCH_AT, MOST_LINES = 80, 70, 3


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines (item_id, image_index, line_seq, text, box, ...) with extents, ``image_pos`` and ``ro_pos``.

    Rows are gaps and islands over the lines by centre: a line continues the row if it overlaps the previous line by
    half of the lower of the two. In a row, lines whose left edge is within half a median thickness of the column's
    first line form a column, which is read downwards.
    """
    image = Window.partitionBy("item_id", "image_index")
    by_y = image.orderBy("cy", "line_seq")
    met = overlap(F.lag("y0").over(by_y), F.lag("y1").over(by_y), F.col("y0"), F.col("y1"))
    fresh = F.coalesce((met < 0.5 * F.least(F.lag("h").over(by_y), F.col("h"))).cast("int"), F.lit(1))
    rows = with_extents(lines).withColumn("tol", F.greatest(F.lit(1.0), 0.5 * F.median("thickness").over(image))).withColumn("fresh", fresh)
    rows = rows.withColumn("rank", F.row_number().over(by_y)).withColumn("row", F.sum("fresh").over(by_y.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.struct("x0", "rank", "cy", "line_seq")
    grouped = rows.groupBy("item_id", "image_index", "row", "tol").agg(F.array_sort(F.collect_list(line)).alias("by_x"))
    empty = F.array().cast("array<struct<col:int,cy:double,at:int,line_seq:int>>")
    start = F.struct(F.lit(-1).alias("col"), F.lit(None).cast("double").alias("x"), empty.alias("out"))

    def place(acc, ln):
        new = acc["x"].isNull() | (ln["x0"] - acc["x"] > F.col("tol"))
        col = F.when(new, acc["col"] + 1).otherwise(acc["col"])
        put = F.struct(col.alias("col"), ln["cy"].cast("double").alias("cy"), F.size(acc["out"]).alias("at"), ln["line_seq"].cast("int").alias("line_seq"))
        return F.struct(col.alias("col"), F.when(new, ln["x0"]).otherwise(acc["x"]).cast("double").alias("x"), F.concat(acc["out"], F.array(put)).alias("out"))

    placed = grouped.withColumn("row_order", F.array_sort(F.aggregate("by_x", start, place)["out"]))
    order = placed.select("item_id", "image_index", "row", F.posexplode("row_order").alias("in_row", "ln")).select("item_id", "image_index", F.col("ln.line_seq").alias("line_seq"), "row", "in_row")
    ranked = rows.drop("rank", "fresh", "tol", "row").join(order.hint("merge"), ["item_id", "image_index", "line_seq"])
    ranked = ranked.withColumn("ro_pos", F.row_number().over(image.orderBy("row", "in_row")))
    first = F.min("line_seq").over(image)
    return ranked.withColumn("image_pos", first).drop("row", "in_row")


def spans(ordered: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """Single lines and joins of up to ``most`` consecutive ones whose centres go down by at most 2.5 median heights.

    Columns: item_id, image_pos, ro_pos, n_lines, text, lines (array of image_index, line_seq, text).
    """
    at = Window.partitionBy("item_id", "image_index").orderBy("ro_pos")
    median = F.median("h").over(Window.partitionBy("item_id", "image_index"))
    limit = 2.5 * F.when(median == 0, 1.0).otherwise(median)
    one = F.struct("image_index", "line_seq", "text")
    rows = ordered.withColumn("limit", limit)
    joined = [F.array(one)]
    goes_on = F.lit(True)
    for i in range(1, most):
        gap = F.lead("cy", i).over(at) - (F.lead("cy", i - 1).over(at) if i > 1 else F.col("cy"))
        goes_on = goes_on & F.coalesce((gap <= F.col("limit")) & (gap >= 0), F.lit(False))
        joined.append(F.when(goes_on, F.array(one, *[F.lead(one, j).over(at) for j in range(1, i + 1)])))
    rows = rows.select("item_id", "image_pos", "ro_pos", F.array(*joined).alias("all")).select("item_id", "image_pos", "ro_pos", F.explode(F.filter("all", lambda x: x.isNotNull())).alias("lines"))
    return rows.withColumn("n_lines", F.size("lines")).withColumn("text", collapse_ws(F.array_join(F.transform("lines", lambda x: x["text"]), " ")))


def best_spans(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """From wanted (item_id, check_id, ord, expected): its columns and the best span's text, score, lines and flags.

    The best has the highest score, then the fewest lines, then comes first. Without candidates the columns are null.
    Each distinct pair of keys is scored once; the text sent to the scoring function is the key only.
    """
    asked = wanted.withColumn("want_key", key(F.col("expected")))
    read = candidates.withColumn("read_key", key(F.col("text")))
    pairs = asked.select("item_id", "want_key").join(read.select("item_id", "read_key").hint("merge"), "item_id").select("want_key", "read_key").distinct()
    scored = pairs.withColumn("score", score_texts("want_key", "read_key"))
    met = asked.join(read.hint("merge"), "item_id").join(scored.hint("merge"), ["want_key", "read_key"])
    order = F.struct((-F.col("score")).alias("s"), "n_lines", "image_pos", "ro_pos")
    best = met.groupBy("item_id", "check_id", "ord").agg(F.min_by(F.struct("text", "score", "lines", "read_key"), order).alias("best"))
    out = asked.join(best.hint("merge"), ["item_id", "check_id", "ord"], "left")
    found = F.col("best.text")
    return out.select(
        *wanted.columns, found.alias("found"), F.col("best.score").alias("score"), F.col("best.lines").alias("lines"),
        (collapse_ws(F.col("expected")) == found).alias("identical"), (fold(F.col("expected")) == fold(found)).alias("fold_equal"), (F.col("want_key") == F.col("best.read_key")).alias("key_equal"))


def status_of(review_at: int = REVIEW_AT, mismatch_at: int = MISMATCH_AT):
    """(status, note code) of a best span."""
    none = F.col("found").isNull()
    status = F.when(none, "not_found").when(F.col("identical") | F.col("fold_equal"), "match").when(F.col("key_equal") | (F.col("score") >= review_at), "needs_review").when(F.col("score") >= mismatch_at, "mismatch").otherwise("not_found")
    note = F.when(none, "nothing read").when(F.col("identical"), "exact").when(F.col("fold_equal") & case_only_difference(F.col("expected"), F.col("found")), "case differs").when(F.col("fold_equal"), "accents, quotes or spacing differ").when(F.col("key_equal"), "punctuation differs")
    note = note.when(F.col("score") >= review_at, "close").when(F.col("score") >= mismatch_at, "differs").otherwise("nothing alike")
    return status, note
