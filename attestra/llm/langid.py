"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte model is learnt: contexts of the last ``order`` bytes, with escapes (method C,
without exclusions) down to shorter contexts and at last to 1/256 for a byte never seen. Under frozen statistics every
(context, byte) pair has one exact code length, so the context trees of all languages flatten into one table:
context -> row (falling back to the longest suffix that any language has seen), row and byte -> bits per language.
A text's code length is a sum of table rows over all of its bytes, computed for all languages at once; the language
that codes the text shortest is predicted.

Scale: training reads a bounded, documented sample (``train_docs`` whole texts a language, picked by hash); what
reaches the driver are its distinct grams. The table is broadcast; its size depends on that sample only. Scoring is
one pass without a shuffle, in slices of half a megabyte, so a very long text needs no more memory than a short one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import hash60

ORDER, TRAIN_DOCS, FOLDS, HELD = 3, 1000, 4, 2
SLICE = 1 << 19
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


class Model(NamedTuple):
    langs: list[str]
    order: int
    symbol: np.ndarray  # byte -> symbol; 0 for all bytes that no language has seen
    row: np.ndarray  # packed context symbols -> row of bits
    bits: np.ndarray  # row * symbols + symbol -> code length in bits, a column for each language


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD) -> Column:
    """Whether the id's crc32 leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                parts = []
                for text in texts:
                    b = np.frombuffer(bytes(order) + text, np.uint8).astype(np.int64)
                    code = np.zeros(len(b) - order, np.int64)
                    for i in range(order + 1):
                        code = code * 256 + b[i : len(b) - order + i]
                    parts.append(np.unique(code, return_counts=True))
                codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

    return run


def build(langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """The table of code lengths from each language's (gram, count) arrays; a gram packs order + 1 bytes."""
    shifts = 8 * np.arange(order, -1, -1)
    raw = {lang: (g[:, None] >> shifts) & 255 for lang, (g, _) in grams.items()}
    seen = np.unique(np.concatenate([r.ravel() for r in raw.values()]))
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    pack = lambda cols: sum((cols[:, i] * size ** (cols.shape[1] - 1 - i) for i in range(cols.shape[1])), np.zeros(len(cols), np.int64))
    coded = {lang: symbol[r] for lang, r in raw.items()}
    row = np.zeros(1, np.int64)
    bits = np.full((1, size, len(langs)), 8.0)  # order -1: one of 256
    for o in range(order + 1):
        # a row for each context of this length that any language has seen; the rest keep the shorter context's row
        row = np.tile(row, size) if o else row
        contexts = np.unique(np.concatenate([pack(c[:, order - o : order]) for c in coded.values()]))
        own = bits[row[contexts]]
        for k, lang in enumerate(langs):
            c = coded[lang]
            at = np.searchsorted(contexts, pack(c[:, order - o : order]))
            n = np.bincount(at * size + c[:, order], grams[lang][1], len(contexts) * size).reshape(-1, size)
            total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                direct, escape = np.log2(total + kinds) - np.log2(n), np.log2(total + kinds) - np.log2(kinds)
            own[:, :, k] = np.where(n > 0, direct, own[:, :, k] + np.where(total > 0, escape, 0.0))
        if o == 0:
            row, bits = np.zeros(1, np.int64), own
        else:
            row[contexts] = len(bits) + np.arange(len(contexts))
            bits = np.concatenate([bits, own])
    return Model(langs, order, symbol, row.astype(np.int32), bits.reshape(-1, len(langs)).astype(np.float32))


def code_lengths(texts: list[bytes], model: Model) -> np.ndarray:
    """Bits of each text under each language."""
    o, size = model.order, int(model.symbol.max()) + 1
    total = np.zeros((len(texts), len(model.langs)))
    ends = np.cumsum([len(t) + o for t in texts])
    whole = np.frombuffer(b"".join(x for t in texts for x in (bytes(o), t)), np.uint8)
    for at in range(0, len(whole) - o, SLICE):
        s = model.symbol[whole[at : at + SLICE + o]]
        context = np.zeros(len(s) - o, np.int64)
        for i in range(o):
            context = context * size + s[i : len(s) - o + i]
        v = model.bits[model.row[context].astype(np.int64) * size + s[o:]]
        place = np.arange(at + o, at + len(s))
        doc = np.searchsorted(ends, place, side="right")
        v[place < (ends - np.fromiter((len(t) for t in texts), np.int64, len(texts)))[doc]] = 0  # the padding before each text
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        total[doc[first]] += np.add.reduceat(v, first, axis=0, dtype=np.float64)
    return total


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            langs, scores, bits = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            asked = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            if asked:
                length = code_lengths([texts[i] for i in asked], m)
                best = length.argmin(1)
                least = length[np.arange(len(asked)), best]
                scores[asked] = 1 / np.exp2(np.maximum(least[:, None] - length, -1000)).sum(1)
                bits[asked] = least / np.array([len(texts[i]) for i in asked])
                for i, b in zip(asked, best, strict=True):
                    langs[i] = m.langs[b]
            out = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores), pa.array(bits, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte"])

    return run


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learns from rows outside the held-out fold whose language and text are known, from about ``train_docs`` whole
    texts a language. None if there is no such row."""
    rows = documents.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(~held_out(F.col("id")) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    counts = rows.groupBy("lang").agg(F.count("*").alias("c"))
    share = F.broadcast(counts.select(F.col("lang").alias("l"), (F.lit(float(train_docs)) / F.col("c") * F.lit(float(1 << 60))).alias("below")))
    sample = rows.join(share, F.col("lang") == F.col("l")).where(hash60(F.concat(F.lit("train"), F.col("id").cast("string"))) < F.col("below"))
    grams = sample.select("lang", "text").mapInArrow(_grams(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if grams.empty:
        return None
    grams = grams.sort_values(["lang", "gram"])
    by = {str(k): (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for k, g in grams.groupby("lang")}
    return build(sorted(by), by, order)


def identify(documents: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each document with lang_pred, score and bits_per_byte.

    lang_pred is one of the model's languages (of equals, the first by name), or ``und`` with score 0 where the text
    is null or empty or has no letter, or where nothing was learnt. ``score`` is the language's share of 2^-bits over
    all languages. Only the text is looked at. Repeated rows give equal rows.
    """
    keep = keep or ["doc_id"]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    own = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    out = own.mapInArrow(_predict(shared), f"{kinds}, lang_pred string, score double, bits_per_byte double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "bits_per_byte")


def in_known_language(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The documents, columns as they were, whose text is in a language of the corpus with a score of ``least``."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, doc_id, text, lang))

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        # only the texts cross to Python; the other columns stay where they are
        found = next(_predict(shared)(iter([pa.RecordBatch.from_arrays([texts], ["t"])])))
        return pa.compute.and_(pa.compute.not_equal(found.column("lang_pred"), "und"), pa.compute.greater_equal(found.column("score"), least))

    return documents.where(known(F.col(text).cast("binary")))
