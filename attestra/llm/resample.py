"""Importance resampling towards a target distribution, in DataFrame operations only.

Every text is a bag of n-grams, hashed to buckets by crc32. Bucket counts of the documents and of the target texts give
each bucket a gain (a smoothed log ratio in thousandths); a document's weight is the sum of its n-grams' gains. A Gumbel
draw that hangs on seed and id only is added, and the highest scores are drawn, which samples without replacement in
proportion to the weights.

Scale: the texts are read twice (bucket counts, weights). Both explode inside the scan's stage: counts are combined to
``buckets`` rows a task before their shuffle, and the sum of a document runs over adjacent rows, so that its shuffle
takes one small row a document, keyed by the row's own number; frequent words and hot ids make no hot key. The gain
table has at most ``buckets`` rows, which is what bounds its broadcast. Ranks come from one distributed sort of small
rows: a row's rank is its place in its partition and the number of rows in the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, stored, words

NGRAM, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
PLACE = (1 << 33) - 1  # the bits of monotonically_increasing_id that count the rows of a partition


def ngrams(w: Column, longest: int = NGRAM) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, repeats kept."""
    def of(v: Column, n: int) -> Column:
        return F.transform(F.slice(v, 1, F.greatest(F.size(v) - (n - 1), F.lit(0))), lambda _, i: F.array_join(F.slice(v, i + 1, n), " "))

    if longest == 1:
        return w
    # inside this outer transform the words are a value, not an expression that each place would compute anew
    return F.flatten(F.transform(F.array(w), lambda v: F.concat(v, *[of(v, n) for n in range(2, longest + 1)])))


def _bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket that has any."""
    each = texts.select(F.explode(ngrams(words(F.col(text)), longest)).alias("f"))
    return each.groupBy(_bucket(F.col("f"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gain_table(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that ``documents`` has; both sides are tables of ``bucket_counts``."""
    t = target.select("bucket", F.col("n").alias("t"))
    all_s, all_t = documents.agg(F.sum("n").alias("all_s")), target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t"))
    d = lambda c: c.cast("double")
    ratio = (d(F.coalesce("t", F.lit(0))) + 1) * (d(F.col("all_s")) + buckets) / ((d(F.col("n")) + 1) * (d(F.col("all_t")) + buckets))
    # one row each: totals
    return documents.join(t, "bucket", "left").join(F.broadcast(all_s)).join(F.broadcast(all_t)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(documents: DataFrame, target: DataFrame, doc_id: str, text: str, target_text: str, longest: int, buckets: int) -> DataFrame:
    """(row, id, n_features, weight) of every document row; ``row`` is the row's own number."""
    counts = stored(bucket_counts(documents, text, longest, buckets))
    gains = stored(gain_table(counts, bucket_counts(target, target_text, longest, buckets), buckets))
    own = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), ngrams(words(F.col(text)), longest).alias("f"))
    each = own.select("row", "id", F.explode_outer("f").alias("f")).select("row", "id", _bucket(F.col("f"), buckets).alias("bucket"))
    met = each.join(F.broadcast(gains), "bucket", "left")
    out = stored(met.groupBy("row").agg(F.first("id").alias("id"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight")))
    discard(counts, gains)
    return out


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with their ``rank`` (1, 2, 3 ...) in this order, which should have no ties, by one distributed sort."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    number = F.monotonically_increasing_id()
    placed = placed.select("*", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit(PLACE)).alias("place"))
    # a row a partition of the sort
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop("part", "place", "before")


def resample(documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document row: doc_id, n_features, weight, score, rank, all but the id long.

    Of the documents with at least ``least_words`` n-grams, floor(percent / 100 of them) are drawn by falling score,
    ties to the smaller id, and have a rank; all others have none. The score is the weight and a Gumbel draw in
    thousandths, from the first 32 bits of sha256("<seed>:<id>").

    Null and wordless texts have no features and weight 0. A null id counts as empty text in the draw and comes last
    among equals. Repeated rows have equal scores and ranks of their own, in the order in which they are read; they count
    each in the buckets. An empty target gives gains against smoothing alone; no documents, no rows. Other columns of
    either table are ignored, whatever their names.
    """
    found = weights(documents, target, doc_id, text, target_text, longest, buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    eligible = F.col("n_features") >= least_words
    drawn = found.where(eligible).count() * percent // 100
    scored = found.select("*", (F.col("weight") + gumbel).alias("score"))
    out = ranked(scored, [eligible.desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()])
    discard(found)
    rank = F.when(eligible & (F.col("rank") <= drawn), F.col("rank"))
    return out.select(F.col("id").alias(doc_id), "n_features", "weight", "score", rank.alias("rank"))


def drawn_documents(documents: DataFrame, target: DataFrame, **options: object) -> DataFrame:
    """The drawn ids with their ranks: what a training job reads, in order of rank."""
    return resample(documents, target, **options).where(F.col("rank").isNotNull())
