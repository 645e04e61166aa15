"""Whitening of embeddings from an exact integer scatter matrix.

Entries become integers (64ths, shifted by OFFSET). Each task subtracts the shift and adds up, in whole numbers of any
size, its vectors and their cross-products; the tasks' figures are summed by Spark in limbs of 40 bits, so that no order
of summation changes a bit. With n vectors, sums S and cross-products C, n*C - S*S is n squared times the covariance,
exactly and whatever the shift was. Only that is converted to floats and decomposed by eigh.

Inside a task, integers are split in limbs of 20 bits and multiplied as floats over at most 8,192 rows at a time: each
such product is a whole number below 2**53, hence exact. Small entries take one limb, so that is one matrix product.

Scale: four passes over the vectors (their length; scatter; identity error; result), none of which shuffles a vector.
The driver holds one d x d matrix, d being the number of dimensions. A task holds one batch.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, OFFSET, COMPONENTS = 64, 1_000_000, 32
ROWS, LIMB, PASSED = 8192, 20, 40  # rows a product; bits of its limbs; bits of the limbs that Spark adds up
LIMBS = 4
LEAST, MOST = -(1 << 63), (1 << 63) - 1 - OFFSET


class Whitening(NamedTuple):
    n: int
    sums: list[int]  # of the shifted vectors
    trace: float
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    mean: tuple[np.ndarray, np.ndarray]  # of the shifted vectors: whole part, rest


def finite_rows(column: pa.Array, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows whose vector has no null and nothing infinite in it, and their entries as doubles.

    With ``d``, of vectors of d entries only, as a matrix; without, the second result is the vectors' lengths.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = np.asarray(column.is_valid())
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    entries = column.flatten()
    flat = np.asarray(entries.cast(pa.float64()).fill_null(math.nan))
    bad = np.bincount(np.repeat(np.arange(len(column)), lengths)[~np.isfinite(flat)], minlength=len(column)) > 0
    keep = there & ~bad
    if d is None:
        return np.flatnonzero(keep), lengths[keep]
    keep &= lengths == d
    return np.flatnonzero(keep), flat[np.repeat(keep, lengths)].reshape(-1, d)


def shifted(entries: np.ndarray) -> np.ndarray:
    """floor(64 * c) as int64, which is x less the shift; what lies beyond 64 bits stays at the last of them."""
    with np.errstate(over="ignore"):
        y = np.floor(entries * STEPS)
    out = np.where(y >= float(MOST), MOST, np.where(y <= float(LEAST), LEAST, 0))
    inside = np.abs(y) < 2.0**62
    out[inside] = y[inside].astype(np.int64)
    between = ~inside & (y < float(MOST)) & (y > float(LEAST))
    out[between] = [int(v) for v in y[between]]
    return out.astype(np.int64)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y of an int64 matrix in whole numbers of any size."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for at in range(0, len(y), ROWS):
        rows = y[at : at + ROWS]
        most = max(int(rows.max()), -int(rows.min())) if rows.size else 0
        limbs = max(1, -(-most.bit_length() // LIMB))
        parts = [(rows >> (LIMB * k) if k == limbs - 1 else (rows >> (LIMB * k)) & ((1 << LIMB) - 1)).astype(np.float64) for k in range(limbs)]
        for k, a in enumerate(parts):
            for m, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (k + m)) if k + m else (a.T @ b).astype(np.int64).astype(object)
    return total


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        found.update(finite_rows(batch.column(0))[1].tolist())
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["d", "n"])


def _scatter(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # row -1 has the number of vectors, then their sums; row i the products of dimension i with itself and later ones
        products, sums, n = np.zeros((d, d), object), np.zeros(d, object), 0
        for batch in batches:
            y = shifted(finite_rows(batch.column(0), d)[1])
            n += len(y)
            products += exact_products(y)
            sums += np.array([int(v) for v in (y >> 32).sum(0)], object) * (1 << 32) + (y & 0xFFFFFFFF).sum(0).astype(object)
        if not n:
            return
        at = [(-1, -1, n), *((-1, j, sums[j]) for j in range(d)), *((i, j, products[i, j]) for i in range(d) for j in range(i, d))]
        limbs = [[int(v) >> (PASSED * k) if k == LIMBS - 1 else (int(v) >> (PASSED * k)) & ((1 << PASSED) - 1) for _, _, v in at] for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in at], pa.int32()), pa.array([j for _, j, _ in at], pa.int32()), *[pa.array(x, pa.int64()) for x in limbs]], ["i", "j", *[f"v{k}" for k in range(LIMBS)]])

    return run


def fit(vectors: DataFrame, embedding: str = "embedding") -> Whitening | None:
    """The whitening of all vectors whose entries are all there and finite; None where there are none.

    Vectors of another length than the commonest (of equally common ones: the longest) are not among them.
    """
    own = vectors.select(F.col(embedding).alias("e"))
    top = own.mapInArrow(_lengths, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if top is None or not top["d"]:
        return None
    d = top["d"]
    limbs = [F.sum(f"v{k}").alias(f"v{k}") for k in range(LIMBS)]
    rows = own.mapInArrow(_scatter(d), "i int, j int, " + ", ".join(f"v{k} long" for k in range(LIMBS))).groupBy("i", "j").agg(*limbs).collect()
    found = {(r["i"], r["j"]): sum(r[f"v{k}"] << (PASSED * k) for k in range(LIMBS)) for r in rows}
    n, sums = found[-1, -1], [found[-1, j] for j in range(d)]
    covariance = np.zeros((d, d))
    trace = 0
    for i in range(d):
        for j in range(i, d):
            exact = n * found[i, j] - sums[i] * sums[j]
            covariance[i, j] = covariance[j, i] = exact / (n * n)  # rounded once
            trace += exact if i == j else 0
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(d)] < 0, -1, 1)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return Whitening(n, sums, trace / (n * n), values, axes, (whole, rest))


def _projection(w: Whitening, components: int) -> np.ndarray:
    """Eigenvectors over the roots of their eigenvalues; a direction without any variance has nan."""
    k = min(components, len(w.values))
    least = max(w.values[0], 0) * len(w.values) * np.finfo(float).eps
    spread = np.where(w.values[:k] > least, w.values[:k], np.nan)
    return w.vectors[:, :k] / np.sqrt(spread)


def _centred(y: np.ndarray, w: Whitening) -> np.ndarray:
    whole, rest = w.mean
    if len(y) and max(int(y.max()), -int(y.min()), int(np.abs(whole).max())) >= 1 << 62:  # beyond what int64 can subtract
        return np.array((y.astype(object) - whole.astype(object)), np.float64) - rest
    return (y - whole) - rest


def deviations(y: np.ndarray, w: Whitening) -> list[int] | np.ndarray:
    """Sum over dimensions of (n * x - S) ** 2, exactly; the shift cancels."""
    most = w.n * (max(int(y.max()), -int(y.min())) if y.size else 0) + max(map(abs, w.sums))
    if most * most * y.shape[1] < 1 << 63:
        off = w.n * y - np.array(w.sums, np.int64)
        return (off * off).sum(1)
    off = w.n * y.astype(object) - np.array(w.sums, object)
    return [int(v) for v in (off * off).sum(1)]


def _apply(w: Whitening, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _projection(w, components)
        k = project.shape[1]
        for batch in batches:
            at, entries = finite_rows(batch.column(1), len(w.sums))
            y = shifted(entries)
            white = (_centred(y, w) @ project).ravel()
            dev = deviations(y, w)
            exact = pa.array(dev, pa.int64()).cast(pa.decimal128(38, 0)) if isinstance(dev, np.ndarray) else pa.array([Decimal(v) if v < 10**38 else None for v in dev], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(white) + 1, k), pa.int32()), pa.array(white, from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), exact, lists], ["id", "deviation", "whitened"])

    return run


def _second_moment(w: Whitening, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = np.nan_to_num(_projection(w, components))
        k = project.shape[1]
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            white = _centred(shifted(finite_rows(batch.column(0), len(w.sums))[1]), w) @ project
            total += white.T @ white
            first += white.sum(0)
        i, j = np.divmod(np.arange(k * k + k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([total.ravel(), first]))], ["i", "j", "v"])

    return run


def identity_error(vectors: DataFrame, w: Whitening, embedding: str = "embedding", components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured over all of them.

    The vectors are centred before they are multiplied, by the exact mean; what rounding leaves of the mean is taken off.
    Directions without variance do not count.
    """
    rows = vectors.select(F.col(embedding).alias("e")).mapInArrow(_second_moment(w, components), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = min(components, len(w.values))
    moments = np.zeros((k + 1, k))
    for r in rows:
        moments[r["i"], r["j"]] = r["v"] / w.n
    real = np.isfinite(_projection(w, components)).all(0)
    off = moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)
    return float(np.abs(off[np.ix_(real, real)]).max(initial=0.0))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and each of its first components: vec_id, component (from 1, by falling eigenvalue), n,
    deviation (decimal, exact), whitened, explained, identity_error.

    Vectors that are null, hold a null or something infinite or not a number, or have another length than most are
    dropped; n counts the others. Entries beyond 64 bits count as the last that fits. Signs are such that an axis's
    largest entry is positive. A component without variance has null in ``whitened``. A deviation of over 38 digits
    is null. Repeated rows give repeated rows, null ids stay, no vectors give no rows, and vectors of no entries have no
    components. Other columns are ignored.
    """
    w = fit(vectors, embedding)
    own = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("e"))
    if w is None:
        own, w = own.limit(0), Whitening(0, [0], 0.0, np.zeros(1), np.ones((1, 1)), (np.zeros(1, np.int64), np.zeros(1)))
        error = 0.0
    else:
        error = identity_error(vectors, w, embedding, components)
    kind = own.schema["id"].dataType.simpleString()
    rows = own.mapInArrow(_apply(w, components), f"id {kind}, deviation decimal(38,0), whitened array<double>")
    share = [float(e / w.trace) if w.trace else 0.0 for e in w.values[:components]]
    each = rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(F.col("id").alias(vec_id), (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(F.array(*map(F.lit, share)), F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
