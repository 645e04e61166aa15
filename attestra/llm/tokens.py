"""Token counts from an exact length histogram.

Documents are encoded once and only their lengths kept: an Arrow stage adds up (length -> documents) within each
partition, so what is shuffled and stored is one row a distinct length, whatever the number of documents. Suffix sums
over that histogram answer, exactly and for every context limit at once, how many documents and tokens fit, how many
tokens remain if texts are cut at the limit, and any quantile of the lengths.

Scale: one pass over the texts, no shuffle of rows. The suffix sums run in two levels (blocks of 1,024 lengths, then
inside a block), so no task holds the whole histogram. The vocabulary file is read on the driver and broadcast; its
size is checked against ``MOST_BYTES``.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_BYTES, BLOCK = 64 << 20, 1024


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes, too large to broadcast")
    return data


def encoding(data: bytes):
    """The tokenizer of a rank file's bytes; strings of special tokens are ordinary text."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_loaded: dict[int, object] = {}


def _encoder(shared):
    if shared.id_ not in _loaded:
        _loaded.clear()
        _loaded[shared.id_] = encoding(shared.data.value)
    return _loaded[shared.id_]


class _Shared:
    def __init__(self, data, id_: int) -> None:
        self.data, self.id_ = data, id_


def _lengths(shared: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found = _encoder(shared).encode_ordinary, Counter()
        for batch in batches:
            found.update(len(encode(t)) if t else 0 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "docs"])

    return run


def length_histogram(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, docs): how many documents encode to so many tokens. Null and empty texts have 0 tokens; repeated
    rows count each; no documents, no rows. Only the text is looked at."""
    data = documents.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    own = documents.select(F.col(text).alias("t")).mapInArrow(_lengths(_Shared(data, data._jbroadcast.id())), "n_tokens long, docs long")
    return own.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """A row for each distinct length L, read as a context limit.

    docs (of that length), tokens (in them), docs_within and tokens_within (length <= L), docs_over (> L),
    truncated_tokens (total if every text is cut at L), quantile (share of documents with length <= L). A limit
    between two lengths L1 < x < L2 has the within-figures of L1 and truncated_tokens + (x - L1) * docs_over.
    """
    h = cut(histogram.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block")))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = blocks.select("block", F.coalesce(F.sum("d").over(below), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(below), F.lit(0)).alias("t0"), F.sum("d").over(whole).alias("all_docs"))
    run = Window.partitionBy("block").orderBy("n_tokens")
    out = h.join(before, "block").withColumn("docs_within", F.col("d0") + F.sum("docs").over(run)).withColumn("tokens_within", F.col("t0") + F.sum("tokens").over(run))
    over = F.col("all_docs") - F.col("docs_within")
    return out.select("n_tokens", "docs", "tokens", "docs_within", "tokens_within", over.alias("docs_over"), (F.col("tokens_within") + F.col("n_tokens") * over).alias("truncated_tokens"), (F.col("docs_within") / F.col("all_docs")).alias("quantile"))


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length with at least this share of documents at or below it, for each share."""
    asked = [F.min(F.when(F.col("quantile") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])
    return limits.agg(*asked).select(F.inline(pairs))
