"""A quality classifier by co-training on two views of a document.

The *content* view sees the text's words and characters; the *metadata* view sees the page around it: source,
language, length and line layout. Each view has a logistic model, fitted on labelled rows. Then, over rounds, each view
scores all documents without a label and hands those it is confident of, with its verdicts as pseudo-labels, to the
other view, which moves by Newton steps on labelled and pseudo-labelled rows together; the pseudo-labelled rows of a
class weigh no more than the labelled ones of it. How far a view is to be trusted is measured on labelled rows that
neither was fitted on. On these both views are then calibrated (Platt), and a last logistic model on the two calibrated logits weighs them into one score for every document.

Scale: fitting reads a bounded, documented sample of labelled rows (about ``LABELLED``, chosen by hash). Unlabelled
rows are all used: features are computed once and written (about 900 bytes a document), and a step of a round is one
pass over them that returns a gradient and a curvature (about 200 KB) from each task, added up in ``PARTS`` tasks.
Nothing else reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .mixing import hash60

LABELLED, ROUNDS, STEPS = 6000, 3, 2
#: Rows of chosen ids that are learnt from as they are; beyond, one an id.
MOST_ROWS = 24_000
#: A view is confident beyond the logit from which on so many of the labelled rows kept apart have the one label, if
#: they are at least so many.
TRUST, WITNESSES = 0.99, 20
#: Least curvature of a row in a step, and in how many parts sums are brought together.
FLAT, PARTS = 0.05, 16
WORDS, NAMES, RIDGE = 128, 32, 1.0

_KIND = np.zeros(256, np.int64)  # letters 0, upper 1, digits 2, blanks 3, ordinary punctuation 4, other symbols 5, past ASCII 6
_KIND[:128] = 5
_KIND[128:] = 6
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b" \t\n\r\x0b\x0c")] = 3
_KIND[list(b".,;:'\"!?()-")] = 4


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = b = xxhash.xxh3_64_intdigest(word)
        return b


_buckets = _Buckets()


def content_features(text: bytes) -> np.ndarray:
    """Shares of character kinds, word statistics and a hashed bag of words."""
    out = np.zeros(16 + WORDS)
    raw = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=7) / max(1, len(raw))
    words = text.lower().split()
    if words:
        h = np.fromiter(map(_buckets.__getitem__, words), np.uint64, len(words))
        _, n = np.unique(h, return_counts=True)
        length = np.fromiter(map(len, words), np.int64, len(words))
        same = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0
        out[7:16] = [len(n) / len(h), n.max() / len(h), same, length.mean() / 10, length.std() / 10, (length == 1).mean(), (length > 20).mean(), np.log1p(len(words)) / 10, 1.0]
        bag = np.bincount((h % np.uint64(WORDS)).astype(np.int64), minlength=WORDS) / len(h)
        out[16:] = np.sqrt(bag)
    out[:7] = np.sqrt(kinds)
    return out


def metadata_features(text: bytes, source: str | None, lang: str | None) -> np.ndarray:
    """Hashed source and language, length and line layout."""
    out = np.zeros(10 + 2 * NAMES)
    out[10 + xxhash.xxh3_64_intdigest(source or "") % NAMES] = 1
    out[10 + NAMES + xxhash.xxh3_64_intdigest(lang or "") % NAMES] = 1
    ends = np.flatnonzero(np.frombuffer(text + b"\n", np.uint8) == 10)
    lines = np.diff(ends, prepend=-1) - 1
    n = len(text)
    out[:10] = [np.log1p(n) / 10, np.log1p(len(lines)) / 10, np.log1p(lines.mean()) / 10, np.log1p(lines.max()) / 10, (lines == 0).mean(), (lines < 30).mean(), (lines > 400).mean(), lines.std() / (1 + lines.mean()), text[-1:].isalnum(), source is None]
    return out


class View(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    low: float = -np.inf  # confident of a bad document below, of a good one above
    high: float = np.inf

    def design(self, x: np.ndarray) -> np.ndarray:
        """Standardised features after a 1; clipped, for what never varies in the labelled rows may elsewhere."""
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * (self.design(x) @ self.weights) + self.shift, -30, 30)


class Model(NamedTuple):
    content: View
    metadata: View
    mix: np.ndarray  # intercept, content, metadata


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression, by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty)
        move = np.linalg.solve(hess, a.T @ (y - p) - penalty * w)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _fit(x: np.ndarray, y: np.ndarray) -> View:
    view = View(x.mean(0), x.std(0) + 1e-3, np.zeros(1 + x.shape[1]))
    return view._replace(weights=logistic(view.design(x)[:, 1:], y))


def _slopes(view: View, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the likelihood; the curvature of rows far from 0 is not taken for less than FLAT."""
    a = view.design(x)
    p = 1 / (1 + np.exp(-np.clip(a @ view.weights, -30, 30)))
    return a.T @ (y - p), (a * np.maximum(p * (1 - p), FLAT)[:, None]).T @ a


def pseudo_sums(teachers: Sequence[View], pupils: Sequence[View], x: Sequence[np.ndarray]) -> np.ndarray:
    """For each pupil view and class, how many rows the other view is confident of, and the pupil's gradient and
    curvature on them, end to end. Sums of parts are the sums of the whole."""
    out = []
    for pupil in (0, 1):
        z = teachers[1 - pupil].logit(x[1 - pupil])
        for label, sure in ((0.0, z <= teachers[1 - pupil].low), (1.0, z >= teachers[1 - pupil].high)):
            gradient, hess = _slopes(pupils[pupil], x[pupil][sure], np.full(sure.sum(), label))
            out += [[float(sure.sum())], gradient, hess[np.triu_indices(len(gradient))]]
    return np.concatenate(out)


def _trusted(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """The view with the bounds of its confidence."""

    def bound(z: np.ndarray, right: np.ndarray) -> float:
        order = np.argsort(-z, kind="stable")
        last = np.flatnonzero(np.append(np.diff(z[order]) != 0, True))  # rows of one logit stand or fall together
        share = np.cumsum(right[order])[last] / (last + 1)
        ok = last[(share >= TRUST) & (last + 1 >= WITNESSES)]
        return float(z[order][ok[-1]]) if len(ok) else np.inf

    z = view.logit(x)
    return view._replace(low=-bound(-z, y == 0), high=bound(z, y == 1))


def _moved(view: View, x: np.ndarray, y: np.ndarray, pseudo: Sequence[np.ndarray]) -> View:
    """One Newton step of a view on labelled rows and on the sums of pseudo-labelled ones."""
    penalty = np.full(len(view.weights), RIDGE)
    penalty[0] = 1e-3
    upper = np.triu_indices(len(penalty))
    move, hess = _slopes(view, x, y)
    for label, part in enumerate(pseudo):
        if part[0]:
            weight = min(1.0, float((y == label).sum()) / part[0])
            move = move + weight * part[1 : 1 + len(penalty)]
            hess[upper] += weight * part[1 + len(penalty) :]
    hess = np.triu(hess) + np.triu(hess, 1).T + np.diag(penalty)
    return view._replace(weights=view.weights + np.linalg.solve(hess, move - penalty * view.weights))


def _length(width: int) -> int:
    return 1 + (width + 1) + (width + 1) * (width + 2) // 2


def co_train(labelled: tuple[np.ndarray, np.ndarray, np.ndarray], sums: Callable[[list[View], list[View]], np.ndarray], rounds: int = ROUNDS, steps: int = STEPS) -> Model:
    """From labelled (content, metadata, quality) and ``sums(teachers, pupils)``, which gives ``pseudo_sums`` over all
    unlabelled rows."""
    c, m, y = labelled
    held = np.arange(len(y)) % 4 == 3  # for calibration
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        held = np.zeros(len(y), bool)
    cal = held if held.any() else ~held
    own = (c[~held], m[~held])
    views = [_fit(x, y[~held]) for x in own]
    for _ in range(rounds):
        teachers = [_trusted(view, x[cal], y[cal]) for view, x in zip(views, (c, m), strict=True)]
        for _ in range(steps):
            at, moved, total = 0, [], sums(teachers, views)
            for view, x in zip(views, own, strict=True):
                n = _length(x.shape[1])
                moved, at = [*moved, _moved(view, x, y[~held], (total[at : at + n], total[at + n : at + 2 * n]))], at + 2 * n
            views = moved
    calibrated = []
    for view, x in zip(views, (c, m), strict=True):
        w = logistic(view.logit(x[cal])[:, None], y[cal])
        calibrated.append(view._replace(slope=float(max(w[1], 1e-3)), shift=float(w[0])))
    both = np.stack([calibrated[0].logit(c[cal]), calibrated[1].logit(m[cal])], 1)
    return Model(calibrated[0], calibrated[1], logistic(both, y[cal], 0.1))


def _features(texts: list, sources: list, langs: list) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or b"" for t in texts]
    c = np.stack([content_features(t) for t in texts]) if texts else np.zeros((0, 16 + WORDS))
    m = np.stack([metadata_features(t, s, g) for t, s, g in zip(texts, sources, langs, strict=True)]) if texts else np.zeros((0, 10 + 2 * NAMES))
    return c.astype(np.float32).astype(float), m.astype(np.float32).astype(float)


def scores(model: Model, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities of quality by content, by metadata, and combined."""
    a, b = model.content.logit(content), model.metadata.logit(metadata)
    both = model.mix[0] + model.mix[1] * a + model.mix[2] * b
    return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, both))


def _wide(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten(), np.float64).reshape(-1, width)


def _added(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in parts:
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["sums"])


def features(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", quality: str = "quality", labelled: int = LABELLED) -> DataFrame:
    """Writes a row per document row: id, c, m (its views' features), y (1 or 0; null without a label), chosen.

    Several labels of an id count as their mean, null ones and those without id not at all. ``chosen`` marks about
    ``labelled`` labelled ids, by hash."""
    marks = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("l_id")).agg((F.avg(quality) >= 0.5).cast("double").alias("y"))
    part = F.lit(float(labelled) / max(marks.count(), 1) * float(1 << 60))
    marks = marks.withColumn("chosen", hash60(F.concat(F.lit("label"), F.col("l_id").cast("string"))) < part)

    @F.arrow_udf("struct<c: array<float>, m: array<float>>")
    def view(t: pa.Array, s: pa.Array, g: pa.Array) -> pa.Array:
        lists: list[list[np.ndarray]] = [[], []]
        for at in range(0, len(t), 1000):
            for out, x in zip(lists, _features(*(x.slice(at, 1000).to_pylist() for x in (t, s, g))), strict=True):
                out.append(x.astype(np.float32))
        wide = lambda x, w: pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * w), pa.array(np.concatenate([np.empty((0, w), np.float32), *x]).ravel()))
        return pa.StructArray.from_arrays([wide(lists[0], 16 + WORDS), wide(lists[1], 10 + 2 * NAMES)], ["c", "m"])

    own = documents.select(F.col(doc_id).alias("id"), view(F.col(text).cast("binary"), F.col(source).cast("string"), F.col(lang).cast("string")).alias("v"))
    return stored(own.join(marks, F.col("id") == F.col("l_id"), "left").select("id", "v.c", "v.m", "y", F.coalesce("chosen", F.lit(False)).alias("chosen")))


def train(rows: DataFrame, most: int = MOST_ROWS) -> Model | None:
    """Learns from the rows of ``features``. None if the chosen labels have fewer than two classes.

    The sample is bounded by rows too: where the chosen ids have more than ``most`` rows in all, one of each id is learnt
    from, the one whose features hash least. So ids with very many rows bring no more to the driver."""
    own = rows.where("chosen")
    if own.count() > most:
        own = own.groupBy("id").agg(F.min_by(F.struct("c", "m", "y"), F.xxhash64("c", "m")).alias("r")).select("id", "r.*")
    own = own.select(F.xxhash64("id").alias("turn"), F.col("id").cast("string").alias("id"), "c", "m", "y").toArrow()
    own = own.take(pa.array(sorted(range(len(own)), key=list(zip(own["turn"].to_pylist(), own["id"].to_pylist(), own["y"].to_pylist(), strict=True)).__getitem__), pa.int64()))
    y = np.array(own["y"].to_pylist(), float)
    if len(np.unique(y)) < 2:
        return None
    widths = (16 + WORDS, 10 + 2 * NAMES)
    length, rest = 2 * sum(map(_length, widths)), rows.where("y is null").select("c", "m")

    def sums(teachers: list[View], pupils: list[View]) -> np.ndarray:
        def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _added(pseudo_sums(teachers, pupils, [_wide(b.column(k), w) for k, w in enumerate(widths)]) for b in batches)

        def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _added(_wide(b.column(0), length).sum(0) for b in batches)

        parts = rest.mapInArrow(of_rows, "sums array<double>").repartition(PARTS).mapInArrow(of_parts, "sums array<double>").toArrow()
        return _wide(parts["sums"], length).sum(0)

    return co_train((_wide(own["c"], widths[0]), _wide(own["m"], widths[1]), y), sums)


def scored(documents: DataFrame, model: Model | None, text: str = "text", source: str = "source", lang: str = "lang") -> Column:
    """A struct column (content_score, metadata_score, score) for each document; 0.5 if nothing was learnt.

    Null texts are scored as empty ones, null sources and languages as a name of their own. Equal rows score equal.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<content_score: double, metadata_score: double, score: double>")
    def run(t: pa.Array, s: pa.Array, g: pa.Array) -> pa.Array:
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, max(1, len(t)), 1000):
            part = [x.slice(at, 1000).to_pylist() for x in (t, s, g)]
            found = scores(shared.value, *_features(*part)) if shared.value else [np.full(len(part[0]), 0.5)] * 3
            for column, x in zip(out, found, strict=True):
                column.append(x)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in out], ["content_score", "metadata_score", "score"])

    return run(F.col(text).cast("binary"), F.col(source).cast("string"), F.col(lang).cast("string"))


def classify(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", least: float = 0.5, **columns: str) -> DataFrame:
    """One row per document row: doc_id, content_score, metadata_score, score, good (score >= ``least``).

    Null texts are scored as empty ones; null sources and languages are names of their own, and a null id has no
    label. Repeated rows are scored alike; an id's label holds for all its rows. Without labels of two classes, or
    without documents that have them, every score is 0.5. No documents, no rows. Other columns, whatever their names,
    change nothing. Texts are read whole.
    """
    rows = features(documents, labels, doc_id, **columns)
    shared = documents.sparkSession.sparkContext.broadcast(train(rows))

    @F.arrow_udf("struct<content_score: double, metadata_score: double, score: double>")
    def run(c: pa.Array, m: pa.Array) -> pa.Array:
        found = scores(shared.value, _wide(c, 16 + WORDS), _wide(m, 10 + 2 * NAMES)) if shared.value else [np.full(len(c), 0.5)] * 3
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["content_score", "metadata_score", "score"])

    return rows.select(F.col("id").alias(doc_id), run("c", "m").alias("q")).select(doc_id, "q.*", (F.col("q.score") >= least).alias("good"))


def good_documents(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The documents, columns as they were, whose score is at least ``least``; the cases are those of ``classify``."""
    rows = features(documents, labels, doc_id)
    model = train(rows)
    discard(rows)
    return documents.where(scored(documents, model).getField("score") >= least)
