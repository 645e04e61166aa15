"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Every benchmark item is cut into windows of consecutive words (13 unless told otherwise; an item with fewer words
is one window). A window is treated as the set of its positioned shingles. A document contains a window only if it
contains all of its shingles, so with shingles ordered from rare to frequent the *necessary prefix* is the single
rarest one: documents are joined to windows on that shingle alone. The length bound (the document must have room for
the window) and the positional bound (the shingle's offset fixes where the window would start) discard most
candidates; the rest are verified word by word. Rarity is counted over all documents.

Scale: the documents are read twice (count, join) and never shuffled. What is shuffled is one small row a document
plus its verified places. The side that is broadcast is cut into blocks of at most ``block_bytes``, whose number
follows from a measured size, so any benchmark fits; each block is one more pass. Frequent words do no harm, because
a window made of frequent words only is still joined on its rarest run of three.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused, words

WINDOW, SHINGLE = 13, 3


def _shingle(tokens: Column, pos: Column, q: int) -> Column:
    """Hash of the q tokens from 0-based ``pos``; tokens past the end are skipped, which verification puts right."""
    return F.xxhash64(*[F.get(tokens, pos + i) for i in range(q)])


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows (``win`` array, ``len`` int) with the sorted distinct ids of their items (``items``).

    Items without an id or without words have no window; repeated items count once.
    """
    own = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w"))
    own = own.where(F.col("item").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size, F.lit(0)) + 1)
    each = own.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), size).alias("win"))
    return each.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("len", F.size("win"))


def _positions(docs: DataFrame, qs: list[int]) -> DataFrame:
    """A row for each document, place and shingle length; place 0 is a header row that matches nothing."""
    each = docs.select("*", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "_w")).drop("_w")
    at = [F.when(F.col("pos") > 0, _shingle(F.col("w"), F.col("pos") - 1, q)) for q in qs]
    if len(qs) == 1:
        return each.select("*", F.lit(qs[0]).alias("q"), at[0].alias("token"))
    several = F.array(*[F.struct(F.lit(q).alias("q"), t.alias("token")) for q, t in zip(qs, at, strict=True)])
    # the header row must stay single, or copies of a document would be miscounted
    several = F.when(F.col("pos") > 0, several).otherwise(F.slice(several, 1, 1))
    return each.select("*", F.inline(several))


def prefix_tokens(documents: DataFrame, windows: DataFrame, qs: list[int]) -> DataFrame:
    """Each window with its rarest shingle over all documents: ``token``, its length ``q`` and its ``off`` set."""
    own = windows.withColumn("q", F.least(F.lit(SHINGLE), F.col("len")))
    hashed = reduce(lambda rest, q: F.when(F.col("q") == q, _shingle(F.col("win"), F.col("off"), q)).otherwise(rest), qs, F.lit(None).cast("long"))
    each = own.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("q"))).alias("off")).withColumn("token", hashed)
    asked = each.select("q", "token").distinct()
    counts = _positions(documents.select("w"), qs).select("q", "token").join(F.broadcast(asked), ["q", "token"], "left_semi").groupBy("q", "token").agg(F.count("*").alias("df"))
    rare = F.min_by(F.struct("off", "token"), F.struct(F.coalesce(F.col("df"), F.lit(0)), F.col("token"), F.col("off")))
    picked = each.join(counts, ["q", "token"], "left").groupBy("win").agg(rare.alias("r"), F.first("items").alias("items"), F.first("len").alias("len"), F.first("q").alias("q"))
    return picked.select("win", "items", "len", "q", "r.off", "r.token")


def contaminated_spans(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items, spans, contaminated.

    ``n_hit`` counts the document's words inside any occurrence of a window; ``items`` are the sorted ids (as strings)
    of the items with an occurring window; ``spans`` are the occurrences as (start, end) word offsets, end excluded.
    ``contaminated``: n_hit > 0 and 20 * n_hit >= n_words.

    Null or wordless texts give zeros and empty arrays. Repeated rows give equal rows, as many as there were; equal
    ids on different texts stay apart. A null id is kept. With an empty benchmark nothing is hit; no documents, no
    rows. Other columns of either table are ignored, whatever their names.
    """
    docs = _found(documents, benchmark, doc_id, text, item_id, item_text, size, block_bytes)
    docs = docs.withColumn("_one", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)))))
    return docs.select(F.col("id").alias(doc_id), "n_words", "n_hit", "n_items", "items", "spans", "contaminated")


def _found(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """The spans of each distinct (id, h), h being the hash of the text, with the number of its copies."""
    own = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), words(F.col(text)).alias("w")).select(
        "id", F.xxhash64(F.coalesce("t", F.lit(""))).alias("h"), F.octet_length("t").alias("bytes"), "w", F.size("w").alias("n"))
    wins = cut(item_windows(benchmark, item_id, item_text, size))
    measured = wins.agg(F.collect_set(F.least(F.lit(SHINGLE), "len")).alias("qs"), F.sum(F.octet_length(F.array_join("win", " ")) + 64 * F.col("len") + F.octet_length(F.array_join("items", " "))).alias("bytes")).first()
    qs = sorted(measured["qs"], reverse=True) or [SHINGLE]
    blocks = max(1, -(-(measured["bytes"] or 0) // block_bytes))
    of = lambda b: wins if blocks == 1 else wins.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
    keys = ["id", "h", "bytes", "n"]
    parts = []
    for b in range(blocks):
        tokens = F.broadcast(cut(prefix_tokens(own, of(b), qs)))
        tokens = tokens.select(*[F.col(c).alias(f"b_{c}") for c in tokens.columns])
        start = F.col("pos") - 1 - F.col("b_off")
        fits = (start >= 0) & (start + F.col("b_len") <= F.col("n"))
        same = F.slice(F.col("w"), F.greatest(start, F.lit(0)) + 1, F.col("b_len")) == F.col("b_win")
        met = _positions(own, qs).join(tokens, (F.col("token") == F.col("b_token")) & (F.col("q") == F.col("b_q")) & fits & same, "left")
        met = met.where((F.col("pos") == 0) | F.col("b_token").isNotNull())
        span = F.when(F.col("pos") > 0, F.struct(start.alias("start"), (start + F.col("b_len")).alias("end")))
        parts.append(met.select(*keys, (F.col("pos") == 0).cast("int").alias("head") if b == 0 else F.lit(0).alias("head"), span.alias("span"), "b_items"))
    rows = reduce(DataFrame.unionByName, parts)
    docs = rows.groupBy(*keys).agg(F.sum("head").alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("b_items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct((a["hit"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("hit"), F.greatest(a["to"], s["end"]).alias("to"))
    docs = docs.withColumn("hit", F.aggregate("spans", zero, step, lambda a: a["hit"]).cast("long"))
    return docs.select("id", "h", F.col("n").cast("long").alias("n_words"), F.col("hit").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", ((F.col("hit") > 0) & (20 * F.col("hit") >= F.col("n"))).alias("contaminated"), "copies")


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents, all columns as they were, that are not contaminated; see ``contaminated_spans``.

    Rows are matched by id, null-safely, and text: other texts of an id, or without id, stay.
    """
    own, text = documents[str(options.get("doc_id", "doc_id"))], documents[str(options.get("text", "text"))]
    bad_id, bad_h = unused(documents, "_bad_id"), unused(documents, "_bad_h")
    bad = _found(documents, benchmark, **options).where("contaminated").select(F.col("id").alias(bad_id), F.col("h").alias(bad_h)).distinct()
    return documents.join(bad, own.eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(bad_h)), "left_anti")
