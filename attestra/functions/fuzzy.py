"""Similarity of short texts by longest common subsequence, as Arrow functions over pairs.

A batch of pairs is scored at once: each stretch of a text that is to be held against a needle is a lane, a lane's row
of the subsequence table is one 64-bit word, and a step takes one character of every lane. Needles past 64 characters
go one by one, with integers of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
#: Lanes worked on at a time.
LANES = 1 << 18


def lcs(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * common / (length of both); two empty texts are equal."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


class _Lanes:
    """Needles of 1 to 64 characters and their texts, ready to be compared stretch by stretch."""

    def __init__(self, needles: Sequence[str], texts: Sequence[str]) -> None:
        self.m = np.fromiter(map(len, needles), np.int64, len(needles))
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        known: dict[str, int] = {}
        for s in needles:
            for c in s:
                known.setdefault(c, len(known) + 1)  # 0: in no needle
        self.masks = np.zeros((len(needles), len(known) + 1), np.uint64)
        for p, s in enumerate(needles):
            for i, c in enumerate(s):
                self.masks[p, known[c]] |= np.uint64(1 << i)
        self.full = np.uint64(2**64 - 1) >> (WORD - self.m).astype(np.uint64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.codes = np.fromiter((known.get(c, 0) for t in texts for c in t), np.int64, int(self.at[-1]))

    def common(self, pair: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Longest common subsequence of each pair's needle with the stretch of its text."""
        out = np.zeros(len(pair), np.int64)
        for k in range(0, len(pair), LANES):
            out[k : k + LANES] = self._common(pair[k : k + LANES], start[k : k + LANES], length[k : k + LANES])
        return out

    def _common(self, pair: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        order = np.argsort(-length, kind="stable")
        pair, at, full = pair[order], self.at[pair[order]] + start[order], self.full[pair[order]]
        row, open_ = full.copy(), np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
        for step, n in enumerate(open_):  # the first n lanes are longer than step
            own = row[:n]
            hit = own & self.masks[pair[:n], self.codes[at[:n] + step]]
            row[:n] = ((own + hit) | (own - hit)) & full[:n]
        out = np.empty(len(pair), np.int64)
        out[order] = self.m[pair] - np.bitwise_count(row)
        return out

    def whole(self) -> np.ndarray:
        """Ratios with the whole texts."""
        pair = np.arange(len(self.m))
        return 200.0 * self.common(pair, np.zeros_like(pair), self.n) / (self.m + self.n)

    def stretches(self) -> np.ndarray:
        """Best ratio with any stretch of the needle's length, or a shorter one at either end; needles are no longer
        than their texts."""
        pair = np.repeat(np.arange(len(self.m)), self.n + self.m - 1)
        first = np.arange(len(pair)) - np.repeat(np.cumsum(self.n + self.m - 1) - (self.n + self.m - 1), self.n + self.m - 1) - self.m[pair] + 1
        start, end = np.maximum(first, 0), np.minimum(first + self.m[pair], self.n[pair])
        best = np.zeros(len(self.m))
        np.maximum.at(best, pair, 200.0 * self.common(pair, start, end - start) / (self.m[pair] + end - start))
        return best


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``ratio`` of each pair."""
    out = np.zeros(len(a))
    short = np.array([0 < len(x) <= WORD for x in a], bool)
    if short.any():
        at = np.flatnonzero(short)
        out[at] = _Lanes([a[i] for i in at], [b[i] for i in at]).whole()
    for i in np.flatnonzero(~short):
        out[i] = ratio(a[i], b[i])
    return out


def _long_stretches(needle: str, text: str) -> float:
    m, n = len(needle), len(text)
    return max(ratio(needle, text[max(i, 0) : min(i + m, n)]) for i in range(1 - m, n))


def partial_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """For each pair, the best ratio of the shorter text with a stretch of the longer: any of its length, or a shorter
    one at either end. Of equally long texts each is the shorter once."""
    out, owner, needles, texts = np.zeros(len(a)), [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if x and x in y or not y:
            out[i] = 100.0
        elif len(x) > WORD:
            out[i] = max(_long_stretches(x, y), _long_stretches(y, x) if len(x) == len(y) else 0.0)
        elif x:
            both = [(x, y), (y, x)] if len(x) == len(y) else [(x, y)]
            owner += [i] * len(both)
            needles += [s for s, _ in both]
            texts += [t for _, t in both]
    if owner:
        np.maximum.at(out, owner, _Lanes(needles, texts).stretches())
    return out


def partial_ratio(a: str, b: str) -> float:
    return float(partial_ratios([a], [b])[0])


def scores(wanted: Sequence[str], read: Sequence[str]) -> np.ndarray:
    """Whole-part of the better of ratio and, for a clearly longer reading, partial ratio less 3; keys go in. Nothing
    is like an empty key."""
    some = np.array([bool(w and r) for w, r in zip(wanted, read, strict=True)], bool)
    out = np.where(some, ratios(wanted, read), 0.0)
    longer = np.flatnonzero(some & np.array([len(r) > len(w) * 1.25 for w, r in zip(wanted, read, strict=True)], bool))
    if len(longer):
        out[longer] = np.maximum(out[longer], partial_ratios([wanted[i] for i in longer], [read[i] for i in longer]) - 3)
    return out.astype(np.int64)


def score(wanted: str, read: str) -> int:
    return int(scores([wanted], [read])[0])


def _over_pairs(f, kind: T.DataType, arrow: pa.DataType):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = list(zip(a.to_pylist(), b.to_pylist(), strict=True))
        distinct = list(dict.fromkeys(p for p in pairs if None not in p))
        found: dict[tuple, float] = {}
        for k in range(0, len(distinct), 2000):
            part = distinct[k : k + 2000]
            found |= zip(part, f([x for x, _ in part], [y for _, y in part]).tolist(), strict=True)
        return pa.array([found.get(p) for p in pairs], arrow)

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


score_texts = _over_pairs(scores, T.IntegerType(), pa.int32())
text_ratio = _over_pairs(ratios, T.DoubleType(), pa.float64())
text_partial_ratio = _over_pairs(partial_ratios, T.DoubleType(), pa.float64())


#: Length of the grams that ``may_reach`` counts.
GRAM = 3


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the partial ratio of two texts can be ``least`` or more, by a count of grams and without any table.

    A stretch with w characters that reaches ``least`` against a needle of m differs from it by d = m + w - 2 * common
    deletions and insertions, of which at most (100 - least) / 100 * (m + w), and w is at most m. Each takes at most
    three of the needle's m - 2 grams away, so all but 3 * d of them must stand in the longer text. Where that asks for no
    gram, every pair may reach it, and with d = 0 the needle must stand there whole. Nothing that reaches it is lost.
    """
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    m = F.length(short)
    # the most edits that a stretch of m, or of fewer characters, can have
    d = F.floor((100 - least) / 100 * 2 * m + 1e-9)
    need = m - (GRAM - 1) - GRAM * d

    def counted(pair: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(pair["x"]) - (GRAM - 1), F.lit(1))), lambda i: F.substring(pair["x"], i, F.lit(GRAM)))
        return F.size(F.filter(grams, lambda g: F.contains(pair["y"], g)))

    met = F.get(F.transform(F.array(F.struct(short.alias("x"), long.alias("y"))), counted), F.lit(0))
    return F.when(d == 0, F.contains(long, short)).when(need <= 0, F.lit(True)).otherwise(met >= need)
