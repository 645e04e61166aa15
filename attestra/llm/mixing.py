"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Each document gets a 60-bit hash of its id. Tokens are summed by source and hash bucket (the top 12 bits); a running
sum over the at most 4,096 buckets of a source finds the bucket in which the source's budget ends. Only documents in
that boundary bucket are summed again by the next 12 bits, and only those in the boundary of that by their whole hash.
The result is one threshold a source: documents whose hash is at or below it are taken. Nothing is sorted but the
histograms, thresholds are nested (a larger budget takes a superset), and reruns agree.

Scale: one pass over the texts gives a slim table (id, source, size, hash), which is checkpointed; the rest reads that.
Sums are pre-aggregated before every shuffle, so a source with a third of all rows is no hot spot. The thresholds,
one row a source, are broadcast only if their measured size is within ``broadcast_bytes``; beyond, the join is salted.
The table of sources (one aggregated row a source) is ranked in one task, which spills if it must.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, token_count

WEIGHTS = (5, 2, 1)
MOST, SALTS = 3, 64


def hash60(key: Column) -> Column:
    """First 60 bits of the md5 of the key as text; null counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size), each source's target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the total. Filling stops at ``most``
    times a source's size; sorted by how soon they fill up, the first k sources are full and the rest share what is
    left by weight, for the smallest k that leaves none above its limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))
    state = ranked.withColumn("left", left).withColumn("rest", rest)
    open_ = F.col("cap").cast("double") * F.col("rest") >= F.col("left").cast("double") * F.col("w")
    first = F.first(F.when(open_, F.struct("left", "rest")), ignorenulls=True)
    share = state.withColumn("at", first.over(all_rows)).withColumn("full", F.max(open_.cast("int")).over(fill.rowsBetween(Window.unboundedPreceding, 0)) == 0)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("at.left") * F.col("w")).cast("double") / F.col("at.rest").cast("double"))
    return share.select("source", "source_size", target.alias("target"))


def _boundary(hist: DataFrame, bucket: str) -> DataFrame:
    """Of a histogram (source, rem, base, bucket, s), the bucket in which base + running sum reaches rem."""
    run = Window.partitionBy("source").orderBy(bucket)
    up_to = hist.withColumn("upto", F.col("base") + F.sum("s").over(run))
    return up_to.where((F.col("upto") >= F.col("rem")) & (F.col("upto") - F.col("s") < F.col("rem"))).select("source", "rem", (F.col("upto") - F.col("s")).alias("base"), bucket)


def _joined(rows: DataFrame, small: DataFrame, on: list[str], is_small: bool) -> DataFrame:
    """Inner join to a side of one row a source, null-safe; salted by the hash if that side is not small."""
    if is_small:
        small = F.broadcast(small)
    else:
        rows = rows.withColumn("salt", F.pmod("h", F.lit(SALTS)))
        small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        on = [*on, "salt"]
    right = small.select(*[F.col(c).alias(f"r_{c}") if c in on else F.col(c) for c in small.columns])
    match = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"r_{c}"))
        match = same if match is None else match & same
    return rows.join(right, match).drop(*[f"r_{c}" for c in on], "salt")


def mix_thresholds(slim: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, broadcast_bytes: int = 8 << 20) -> tuple[DataFrame, bool]:
    """From (source, size, h): a row a source (source, source_size, target, times, threshold), and whether it is
    small enough to broadcast. A document counts ``times`` and once more if its hash is at or below the threshold."""
    sizes = cut(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    measured = sizes.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64).alias("b")).first()["b"] or 0
    is_small = measured <= broadcast_bytes
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = cut(source_targets(sizes, weights, most).withColumn("times", times).withColumn("rem", F.col("target") - F.col("times") * F.col("source_size")))
    asked = targets.where("rem > 0").select("source", "rem", F.lit(0).cast("long").alias("base"))

    def level(rows: DataFrame, at: DataFrame, on: list[str], bucket: Column) -> DataFrame:
        hist = _joined(rows, at, on, is_small).groupBy("source", "rem", "base", bucket.alias("b")).agg(F.sum("size").alias("s"))
        return hist

    slim = slim.withColumn("b1", F.shiftright("h", 48)).withColumn("b2", F.shiftright("h", 36))
    one = cut(_boundary(level(slim, asked, ["source"], F.col("b1")), "b").withColumnRenamed("b", "b1"))
    two = cut(_boundary(level(slim, one, ["source", "b1"], F.col("b2")), "b").withColumnRenamed("b", "b2"))
    last = level(slim, two, ["source", "b2"], F.col("h"))
    run = Window.partitionBy("source").orderBy("b")
    last = last.withColumn("upto", F.col("base") + F.sum("s").over(run))
    nearest = (F.col("upto") <= F.col("rem")) | ((F.col("upto") - F.col("s") < F.col("rem")) & (F.col("upto") - F.col("rem") < F.col("rem") - (F.col("upto") - F.col("s"))))
    start = F.shiftleft(F.shiftright(F.min("b"), 36), 36) - 1
    found = last.groupBy("source").agg(F.coalesce(F.max(F.when(nearest, F.col("b"))), start).alias("threshold")).withColumnRenamed("source", "f_source")
    out = targets.join(found, F.col("source").eqNullSafe(F.col("f_source")), "left")
    return cut(out.select("source", "source_size", "target", "times", F.coalesce("threshold", F.lit(-1)).alias("threshold"))), is_small


def mix(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken.

    ``size`` is the number of tokens between ASCII blanks; ``taken`` is a multiple (0 to ``most``) of it. A source's
    taken words differ from its target by at most half of the one document at the boundary. Rows with one id share a
    hash and are taken or left together, as are all rows without id; a null source is a source of its own, ranked
    last; null and empty texts have size 0 and are never taken. A source of size 0 has target 0. No documents, no
    rows. Other columns are ignored, whatever their names.
    """
    slim = cut(documents.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), token_count(F.col(text)).alias("size"), hash60(F.col(doc_id)).alias("h")))
    found, is_small = mix_thresholds(slim, weights, most)
    return _joined(slim, found, ["source"], is_small).select(F.col("id").alias(doc_id), "size", "source_size", "target", (F.col("size") * (F.col("times") + (F.col("h") <= F.col("threshold")).cast("long"))).alias("taken"))


def mixed_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``repeats``, how often each is to be seen.
    The texts are not shuffled: each row is held against its source's threshold. If the table has a column
    ``repeats`` already, it is replaced."""
    slim = cut(documents.select(F.col(source).alias("source"), token_count(F.col(text)).alias("size"), hash60(F.col(doc_id)).alias("h")))
    found, is_small = mix_thresholds(slim, weights, most)
    inner = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("doc"), F.col(source).alias("source"), hash60(F.col(doc_id)).alias("h"), token_count(F.col(text)).alias("size"))
    times = F.col("times") + (F.col("h") <= F.col("threshold")).cast("long")
    kept = _joined(inner, found, ["source"], is_small).where((F.col("size") > 0) & (times > 0))
    return kept.select("doc.*", times.alias("repeats")) if "repeats" not in documents.columns else kept.select(*[F.col(f"doc.{c}") for c in documents.columns if c != "repeats"], times.alias("repeats"))
