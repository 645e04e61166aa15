"""Language-model scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Its vocabulary grows with the corpus. Of N training tokens, every token that occurs at least sqrt(N) / OFTEN times (and
LEAST times) has embeddings of its own, as context and as output: by their counts there are at most OFTEN * sqrt(N) of
them, which bounds the model and its broadcast. The rarer ones share groups by their last bytes; inside a group a token has its
smoothed share of the group's count.

The output is a tree of two levels, so that a token costs the square root of the vocabulary: classes (one that ends a
text, the groups, and about sqrt(V) clusters of the V tokens with embeddings, balanced by the roots of their
counts), then the tokens of a cluster. Both levels are log-bilinear: the embeddings of the CONTEXT tokens before,
each scaled position by position, are summed and multiplied with an output embedding and a bias. Batched matrix products normalise
both levels exactly.

Training sees every training document once, in ROUNDS slices by a hash of id and text. The documents of a slice are dealt to shards
by the same hash and ordered by it, so that neither files nor partitions decide what is learnt. Each shard runs
stochastic gradient steps on its own tokens from the common model, against noise drawn from the frequencies of the classes and of
the tokens in a cluster, and touches only the rows that a batch names. What shards learnt of a row is averaged by how
often each met it, and is the start of the next slice. Shards hold SHARD tokens or 250 * sqrt(N), so that their number grows with the root of
the corpus, and so do the rows that are averaged.

Counts are exact over the whole open vocabulary. Tokens with embeddings and the most frequent others (at most ``FREQUENT``, found by a
histogram of the counts), of at most LONGEST bytes each, are broadcast with their counts; every other token of a text is joined to the counts by a
shuffle. Frequent tokens never enter that shuffle, so it has no hot key.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .langid import held_out

CONTEXT, WIDTH, OFTEN, LEAST = 4, 16, 8, 5
FREQUENT, LONGEST, NOISE, INNER, BATCH, RATE, ROUNDS = 150_000, 64, 32, 1, 2048, 0.1, 4
FOLDS, HELD = 7, 2
END, BLANK = 0, 0x20
#: Training tokens of a shard, at least.
SHARD = 2_000_000
#: Distinct tokens that one task adds up before it passes them on, and positions that are scored at once.
HELD_TOKENS, AT_ONCE = 300_000, 16_384
#: Bytes of text that are split at once.
PIECE = 4 << 20
#: Positions whose class scores are held at once, few enough for a core's cache, and scores that need no shift in float32.
BLOCK, SAFE = 1024, 60.0


class Model(NamedTuple):
    context: np.ndarray  # (units, WIDTH) embeddings of what was seen
    scale: np.ndarray  # (CONTEXT, WIDTH)
    output: np.ndarray  # (classes, WIDTH + 1), the last column is the bias
    word: np.ndarray  # (tokens with embeddings, WIDTH + 1)


def tokens_of(text: bytes | None) -> list[bytes]:
    """ASCII lower-cased parts between the six ASCII blanks; bytes methods touch nothing else."""
    return text.lower().split() if text else []


def pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """``tokens_of`` all texts of a column, in stretches of about PIECE bytes: the first text, the tokens one text after another,
    and how many each text has. Arrow's functions for ASCII look at bytes alone and take the same blanks."""
    texts = column.cast(pa.binary())
    upto = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64)) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)] if len(texts) else []
    for at, end in zip(cuts, cuts[1:], strict=False):
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts[at:end].view(pa.string())))
        tokens = parts.flatten().view(pa.binary())
        some = np.asarray(pc.binary_length(tokens)) > 0  # beside a blank at either end there is an empty part
        ends = np.cumsum(np.asarray(pc.list_value_length(parts).fill_null(0)), dtype=np.int64)
        lengths = np.diff(np.append(0, np.cumsum(some, dtype=np.int64))[ends], prepend=0)
        yield at, tokens if some.all() else tokens.filter(pa.array(some)), lengths


class Vocabulary:
    """The frequent tokens with their counts, most frequent first; the first ``own`` have embeddings.

    Units, which contexts and targets are made of: the end, the groups, then the tokens with embeddings. Classes: the
    end, the groups, then the clusters; cluster c holds the tokens ``edge[c]`` to ``edge[c + 1]``.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], own: int) -> None:
        self.listed = pa.array([t for t, _ in frequent], pa.binary())
        self.count = np.array([n for _, n in frequent], np.float64)
        self.own = own
        self.groups = max(8, math.isqrt(own))
        roots = np.cumsum(np.sqrt(self.count[:own]))
        clusters = np.floor(roots / (roots[-1] * (1 + 1e-9)) * self.groups).astype(np.int64) if own else np.zeros(0, np.int64)
        clusters = np.unique(clusters, return_inverse=True)[1]  # none is empty
        self.edge = np.append(np.flatnonzero(np.diff(clusters, prepend=-1)), own)
        self.classes = self.groups + len(self.edge)
        self.units = 1 + self.groups + own
        self.class_of = np.concatenate([np.arange(1 + self.groups), 1 + self.groups + clusters]).astype(np.int32)
        self.unit = np.array([1 + self.groups + i if i < own else self.rare(t) for i, (t, _) in enumerate(frequent)] + [END], np.int32)
        # the group by the last two bytes; a token has no blank, so one before the last byte says that there is no other
        self.tail = np.array([self.rare(bytes([k >> 8, k & 255])[k >> 8 == BLANK :]) for k in range(1 << 16)], np.int32)

    @property
    def index(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.listed.to_pylist())}

    def rare(self, token: bytes) -> int:
        return 1 + zlib.crc32(token[-2:]) % self.groups

    def read(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Place in the list (-1: not in it) and unit of each token, and the tokens that are not in it."""
        at = np.asarray(pc.index_in(tokens, value_set=self.listed).fill_null(-1))
        units, rare = self.unit.take(at, mode="wrap"), np.flatnonzero(at < 0)
        others = tokens.take(pa.array(rare))
        if len(others):
            _, upto, text = others.buffers()
            upto, text = np.frombuffer(upto, np.int32)[others.offset :][: len(others) + 1], np.frombuffer(text, np.uint8)
            before = np.where(np.diff(upto) > 1, text.take(upto[1:] - 2, mode="wrap"), BLANK)
            units[rare] = self.tail.take(before.astype(np.int32) << 8 | text.take(upto[1:] - 1))
        return at, units, others


class Noise:
    """Frequencies that noise is drawn from: of classes, and of tokens inside their cluster."""

    def __init__(self, vocabulary: Vocabulary, frequency: np.ndarray) -> None:
        own = vocabulary.count[: vocabulary.own]
        self.share = frequency / frequency.sum()
        self.upto_class = np.cumsum(self.share)
        self.log_class = np.log(self.share).astype(np.float32)
        self.upto = np.concatenate([[0.0], np.cumsum(own)])
        self.size = np.diff(vocabulary.edge)
        cluster = np.repeat(np.arange(len(self.size)), self.size)
        self.low, self.mass = self.upto[vocabulary.edge[:-1]], np.diff(self.upto[vocabulary.edge])
        self.log_word = np.log(own / self.mass[cluster]).astype(np.float32) if len(own) else np.zeros(0, np.float32)

    def inside(self, clusters: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        """k tokens of each of the clusters, by their counts."""
        x = self.low[clusters][:, None] + rng.random((len(clusters), k)) * self.mass[clusters][:, None]
        return np.searchsorted(self.upto, x, "right") - 1


def start(vocabulary: Vocabulary, noise: Noise, seed: int = 1) -> Model:
    """Small random embeddings, and biases that give the frequencies."""
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    with_bias = lambda log: np.concatenate([small(len(log), WIDTH), log[:, None]], 1)
    return Model(small(vocabulary.units, WIDTH), np.ones((CONTEXT, WIDTH), np.float32), with_bias(noise.log_class), with_bias(noise.log_word))


def _climb(x: np.ndarray, square: np.ndarray, met: np.ndarray, ids: np.ndarray, rows: np.ndarray, rate: float) -> None:
    """Adds up the gradients of each row and moves only those rows; Adagrad: each parameter has its own pace.
    ``rows`` have an even number of columns, of which x may lack the last: two are added up at a time, as a complex number."""
    order = np.argsort(ids.astype(np.uint16) if len(x) <= 1 << 16 else ids, kind="stable")  # short integers are sorted by radix
    ids = ids.take(order)
    new = np.ones(len(ids) + 1, bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:-1])
    edges = np.flatnonzero(new)
    own, g = ids.take(edges[:-1]), np.add.reduceat(rows.view(np.complex64).take(order, axis=0), edges[:-1], axis=0).view(np.float32)[:, : x.shape[1]]
    met[own] += edges[1:] - edges[:-1]
    paced = g * g
    paced += square.take(own, axis=0)
    square[own] = paced
    np.sqrt(paced, out=paced)
    paced += 1e-6
    np.divide(g, paced, out=paced)
    paced *= rate
    paced += x.take(own, axis=0)
    x[own] = paced


def scales(m: Model) -> np.ndarray:
    """(CONTEXT * WIDTH, WIDTH): each position's scale on a diagonal, so that scaling and adding up are one product."""
    return (m.scale[:, :, None] * np.eye(WIDTH, dtype=np.float32)).reshape(-1, WIDTH)


def summed(m: Model, seen: np.ndarray, scaled: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The context's vector of each row of units, with a 1 for the bias; and the embeddings that it was made of.
    ``scaled``: the model's ``scales``, if they are at hand."""
    met = m.context.take(seen.ravel(), axis=0).reshape(len(seen), -1)
    q = np.ones((len(seen), WIDTH + 1), np.float32)
    q[:, :WIDTH] = met @ (scales(m) if scaled is None else scaled)
    return q, met


def _odds(scores: np.ndarray, noise: np.ndarray, k: int) -> np.ndarray:
    """1 / (1 + k * noise / exp(score)), with the logarithms of noise; in place of the scores."""
    np.subtract(noise + np.float32(math.log(k)), scores, out=scores)
    np.exp(scores, out=scores)
    scores += 1
    return np.reciprocal(scores, out=scores)


def step(m: Model, vocabulary: Vocabulary, noise: Noise, seen: np.ndarray, target: np.ndarray, squares: Model, met: Model, rng: np.random.Generator, rate: float = RATE) -> None:
    """One ascent step on a batch, in place: data against noise classes that the batch shares, and against noise tokens
    of each target's own cluster.

    Each example weighs its k noises against its one true class or token by the odds of the model's unnormalised score
    to k times the noise probability.
    """
    scaled, n, width = scales(m), len(target), WIDTH + 1
    (q, embedded), classes = summed(m, seen, scaled), vocabulary.class_of.take(target)
    drawn = np.searchsorted(noise.upto_class, rng.random(NOISE)).clip(max=len(noise.share) - 1)
    own, other = m.output.take(classes, axis=0), m.output[drawn]
    up = 1 - _odds(np.einsum("nd,nd->n", q, own), noise.log_class.take(classes), NOISE)  # 1 - P(data)
    down = _odds(q @ other.T, noise.log_class[drawn], NOISE)  # P(data) of noise
    own *= up[:, None]
    grad = np.subtract(own, down @ other, out=own)
    ids, rows = np.concatenate([classes, drawn]), np.zeros((n + NOISE, width + width % 2), np.float32)
    np.multiply(q, up[:, None], out=rows[:n, :width])
    np.negative(down.T @ q, out=rows[n:, :width])

    token = target - 1 - vocabulary.groups
    at = np.flatnonzero(token >= 0)
    cluster = classes.take(at) - 1 - vocabulary.groups
    several = noise.size.take(cluster) > 1
    at, cluster = at[several], cluster[several]
    inner = None
    if len(at):
        token, q_in = token.take(at), q.take(at, axis=0)
        others = noise.inside(cluster, INNER, rng)
        true, false = m.word.take(token, axis=0), m.word.take(others.ravel(), axis=0).reshape(len(at), INNER, -1)
        up = 1 - _odds(np.einsum("nd,nd->n", q_in, true), noise.log_word.take(token), INNER)
        down = _odds(np.einsum("nkd,nd->nk", false, q_in), noise.log_word.take(others), INNER)
        true *= up[:, None]
        false *= down[:, :, None]
        true -= false.sum(1) if INNER > 1 else false[:, 0]
        grad[at] += true
        moved = np.zeros((len(at) * (1 + INNER), width + width % 2), np.float32)
        np.multiply(q_in, up[:, None], out=moved[: len(at), :width])
        np.multiply(q_in[:, None], -down[:, :, None], out=moved[len(at) :].reshape(len(at), INNER, -1)[:, :, :width])
        inner = np.concatenate([token, others.ravel()]), moved

    grad = np.ascontiguousarray(grad[:, :WIDTH])
    scale = (grad.T @ embedded).reshape(WIDTH, CONTEXT, WIDTH).diagonal(axis1=0, axis2=2)
    _climb(m.output, squares.output, met.output, ids, rows, rate)
    _climb(m.context, squares.context, met.context, seen.ravel(), (grad @ scaled.T).reshape(-1, WIDTH), rate)
    _climb(m.scale, squares.scale, met.scale, np.arange(CONTEXT), np.ascontiguousarray(scale), rate)
    if inner:
        _climb(m.word, squares.word, met.word, *inner, rate)


def positions(units: np.ndarray, lengths: np.ndarray | list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets of a text's units, with the end as last target and before the first token. With ``lengths``,
    of as many texts whose units stand one after another."""
    n = np.array([len(units)] if lengths is None else lengths, np.int64)
    text = np.arange(len(n))
    padded = np.full(len(units) + CONTEXT * (len(n) + 1), END, np.int32)  # as many ends before each text and after the last
    padded[np.arange(len(units)) + np.repeat(CONTEXT * (1 + text), n)] = units
    at = np.arange(len(units) + len(n)) + np.repeat(CONTEXT + (CONTEXT - 1) * text, n + 1)
    seen = np.empty((len(at), CONTEXT), np.int32)
    for i in range(CONTEXT):
        seen[:, i] = padded.take(at - (CONTEXT - i))
    return seen, padded.take(at)


def _log_share(scores: np.ndarray, at: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """The normalised log share of column ``at`` of each row. ``room``: an array of the shape of ``scores`` to work in.

    Rows are taken as they are; those whose sum leaves the range where float32 is exact enough are shifted by their largest score.
    """
    own = scores[np.arange(len(at)), at]
    with np.errstate(over="ignore", divide="ignore"):
        sums = np.exp(scores, out=room) @ np.ones(scores.shape[1], np.float32)
        out = own - np.log(sums)
    far = np.flatnonzero(~((sums > math.exp(-SAFE)) & (sums < math.exp(SAFE))))
    if len(far):
        top = scores[far].max(1)
        out[far] = own[far] - top - np.log(np.exp(scores[far] - top[:, None]).sum(1))
    return out


def log_probabilities(m: Model, vocabulary: Vocabulary, seen: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Normalised natural log probability of each target unit after what was seen."""
    out, scaled, room = np.empty(len(target), np.float64), scales(m), np.empty((2, BLOCK, len(m.output)), np.float32)
    for lo in range(0, len(target), AT_ONCE):
        unit = target[lo : lo + AT_ONCE]
        q, found, classes = np.empty((len(unit), WIDTH + 1), np.float32), out[lo : lo + AT_ONCE], vocabulary.class_of.take(unit)
        for i in range(0, len(unit), BLOCK):
            own = summed(m, seen[lo + i : min(lo + i + BLOCK, lo + len(unit))], scaled)[0]
            q[i : i + BLOCK] = own
            found[i : i + BLOCK] = _log_share(np.matmul(own, m.output.T, out=room[0, : len(own)]), classes[i : i + BLOCK], room[1, : len(own)])
        order = np.argsort(classes.astype(np.uint16) if len(m.output) <= 1 << 16 else classes, kind="stable")
        first = np.searchsorted(classes.take(order), 1 + vocabulary.groups + np.arange(len(vocabulary.edge)))
        order, first = order[first[0] :], first - first[0]  # those in clusters, one cluster after another
        q, place, shares = q.take(order, axis=0), unit.take(order) - 1 - vocabulary.groups, np.empty(len(order))
        for c in np.flatnonzero(np.diff(first)).tolist():
            (a, b), (i, j) = vocabulary.edge[c : c + 2], first[c : c + 2]
            shares[i:j] = _log_share(q[i:j] @ m.word[a:b].T, place[i:j] - a)
        found[order] += shares
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of this partition, and its number of texts as the count of the empty token."""
    found, rows, texts = [], 0, 0

    def summed_up() -> pa.Table:
        return pa.concat_tables(found).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])

    for batch in batches:
        texts += len(batch)
        for _, tokens, _ in pieces(batch.column(0)):
            found.append(pa.table(tokens.value_counts().flatten(), ["token", "n"]))
            rows += len(found[-1])
            if rows > 2 * HELD_TOKENS:
                found = [summed_up()]
                rows = len(found[0])
                if rows > HELD_TOKENS:
                    yield from found.pop().to_batches()
                    rows = 0
    found.append(pa.table({"token": pa.array([b""]), "n": pa.array([texts], pa.int64())}))
    yield from summed_up().to_batches()


def _trained(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, noise, model, squares = shared.value
        model, squares = Model(*[x.copy() for x in model]), Model(*[x.copy() for x in squares])
        met = Model(*[np.zeros(len(x), np.int64) for x in model])
        rng = np.random.default_rng(7)
        units, waiting = [], 0

        def learn() -> None:
            nonlocal units, waiting
            s, t = positions(np.concatenate(units), list(map(len, units)))
            order = rng.permutation(len(t))
            for at in range(0, len(t), BATCH):
                own = order[at : at + BATCH]
                step(model, vocabulary, noise, s.take(own, axis=0), t.take(own), squares, met, rng)
            units, waiting = [], 0

        for batch in batches:
            for _, tokens, lengths in pieces(batch.column(0)):
                for own in np.split(vocabulary.read(tokens)[1], np.cumsum(lengths)[:-1]):
                    units.append(own)
                    waiting += len(own) + 1
                    if waiting > 64 * BATCH:
                        learn()
        if waiting:
            learn()
        for part, (x, square, times) in enumerate(zip(model, squares, met, strict=True)):
            rows = np.flatnonzero(times)
            for lo in range(0, len(rows), 10_000):
                own = rows[lo : lo + 10_000]
                values = np.zeros((len(own), 2 * WIDTH + 2))
                values[:, : x.shape[1]], values[:, WIDTH + 1 : WIDTH + 1 + x.shape[1]] = x[own], square[own]
                columns = [pa.array(np.full(len(own), part), pa.int32()), pa.array(own, pa.int64()), pa.array(times[own])]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(v) for v in values.T.copy()], ["part", "row", "times", *PARAMETERS])

    return run


#: A row's parameters with its bias, then their sums of squared gradients.
PARAMETERS = [f"v{i}" for i in range(2 * WIDTH + 2)]


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model, groups = shared.value
        # by place; the last one, at -1, is nothing
        known = np.append(np.log10(vocabulary.count + 1), 0.0)
        inside = np.where(np.arange(len(known)) < vocabulary.own, 0.0, known)
        below = np.zeros(vocabulary.units)
        below[1 : 1 + vocabulary.groups] = np.log10(groups)
        serial = TaskContext.get().partitionId() << 40

        for batch in batches:
            for first, tokens, lengths in pieces(batch.column(1)):
                docs, texts = batch.column(0)[first : first + len(lengths)], np.arange(len(lengths))
                places, units, others = vocabulary.read(tokens)
                text = np.repeat(texts, lengths)
                at = np.full(len(tokens) + len(docs), -1)
                at[np.arange(len(tokens)) + text] = places
                seen, target = positions(units, lengths)
                each = log_probabilities(model, vocabulary, seen, target) / math.log(10) - below.take(target) + inside[at]
                starts = np.cumsum(lengths + 1) - lengths - 1
                # a row for each document, under a token that no text has, then one for each of its rarer tokens
                rare = others.dictionary_encode()
                kinds = max(1, len(rare.dictionary))
                pairs, times = np.unique(text[places < 0] * kinds + np.asarray(rare.indices), return_counts=True)
                columns = [
                    serial + np.concatenate([texts, pairs // kinds]),
                    pa.concat_arrays([docs, pa.nulls(len(pairs), docs.type)]),
                    pa.concat_arrays([pa.array([b" %d" % r for r in (serial + texts).tolist()], pa.binary()), rare.dictionary.take(pa.array(pairs % kinds))]),
                    np.concatenate([np.ones(len(docs), np.int64), times]),
                ]
                for sums in (lengths + 1, np.add.reduceat((at >= 0).astype(np.int64), starts), np.add.reduceat(known[at], starts), np.add.reduceat(each, starts)):
                    columns.append(np.concatenate([sums, np.zeros(len(pairs), sums.dtype)]))
                serial += len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "id", "token", "n", "tokens", "known", "base", "score"])

    return run


def token_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over all texts; the empty token stands for the end of a text, of which each row has one."""
    return documents.select(F.col(text).alias("t")).mapInArrow(_counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 0")


def dealt(documents: DataFrame, doc_id: str, text: str, shards: int, slice_: int = 0, slices: int = 1) -> DataFrame:
    """The texts (column ``t``) of a slice in ``shards`` partitions, the same ones in the same order whatever the layout of the
    input. Only documents without an id are dealt by their place, or all copies of a text would be one shard's."""
    place = F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id())
    own = documents.select(F.col(text).alias("t"), F.xxhash64(doc_id, text, place).alias("h"))
    return own.where(F.pmod("h", F.lit(slices)) == slice_).repartition(shards, "h").sortWithinPartitions("h").select("t")


def train(documents: DataFrame, counts: DataFrame, tokens: int, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, Model, np.ndarray]:
    """Vocabulary, model, and each group's smoothed total (its tokens, kinds and one for the unseen).
    ``tokens`` is the sum of the counts."""
    words = counts.where(F.octet_length("token") > 0)
    short = words.where(F.octet_length("token") <= LONGEST)
    often = max(LEAST, math.isqrt(tokens) // OFTEN)
    # counts in steps of a 64th of a doubling; as many whole steps from the top as hold at most FREQUENT tokens
    step_of = F.floor(F.log2("n") * 64).cast("int")
    steps = short.groupBy(step_of.alias("s")).agg(F.count("*").alias("c")).collect()
    least, held = None, 0
    for r in sorted(steps, key=lambda r: -r["s"]):
        if (held := held + r["c"]) > FREQUENT:
            break
        least = r["s"]
    rows = short.where((F.col("n") >= often) | ((step_of >= least) if least is not None else F.lit(False))).collect()
    frequent = sorted(((bytes(r["token"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))
    vocabulary = Vocabulary(frequent, sum(n >= often for _, n in frequent))
    group = F.pmod(F.crc32(F.substring("token", -2, 2)), F.lit(vocabulary.groups))
    totals, kinds = np.zeros(vocabulary.groups), np.zeros(vocabulary.groups)
    for r in words.groupBy(group.alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        totals[r["g"]], kinds[r["g"]] = r["n"], r["k"]
    for t, n in frequent[: vocabulary.own]:
        totals[vocabulary.rare(t) - 1] -= n
        kinds[vocabulary.rare(t) - 1] -= 1
    ends = counts.where(F.octet_length("token") == 0).agg(F.sum("n")).first()[0] or 0
    clusters = np.add.reduceat(vocabulary.count[: vocabulary.own], vocabulary.edge[:-1]) if vocabulary.own else []
    noise = Noise(vocabulary, np.concatenate([[ends], totals, clusters]) + 1)
    model = start(vocabulary, noise)
    squares = Model(*[np.zeros_like(x) for x in model])
    spark = documents.sparkSession
    shards = max(1, -(-tokens // (rounds * max(SHARD, 250 * math.isqrt(tokens)))))
    for at in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, noise, model, squares))
        local = dealt(documents, doc_id, text, shards, at, rounds).mapInArrow(_trained(shared), "part int, row long, times long, " + ", ".join(f"{v} double" for v in PARAMETERS))
        mean = local.groupBy("part", "row").agg(*[(F.sum(F.col(v) * F.col("times")) / F.sum("times")).cast("float").alias(v) for v in PARAMETERS]).toArrow()
        part, row = np.asarray(mean["part"]), np.asarray(mean["row"])
        values = np.stack([np.asarray(mean[v]) for v in PARAMETERS], 1)
        for k, (x, square) in enumerate(zip(model, squares, strict=True)):
            own = part == k
            x[row[own]], square[row[own]] = values[own, : x.shape[1]], values[own, WIDTH + 1 : WIDTH + 1 + x.shape[1]]
        shared.unpersist()
    return vocabulary, model, totals + kinds + 1


def score(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents outside the held-out fold. Tokens are the parts between ASCII blanks, A-Z lower-cased, and
    one end a text; a null text is an empty one and has the end only. base_score sums log10((c + 1) / (N + V + 1))
    with exact counts; score is the model's log10 probability of the text, normalised over the open vocabulary.
    A null id counts as the empty text when folds are dealt. Repeated rows give equal rows. Without training
    documents all counts are 0 and the model is uniform but for its start. Other columns are ignored.
    """
    own = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    learnt = own.where(~held_out(F.col("id"), FOLDS, HELD))
    counts = cut(token_counts(learnt, "t"))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.octet_length("token") == 0, F.col("n"))).alias("ends")).first()
    n, v, ends = total["n"] or 0, total["v"], total["ends"] or 0
    vocabulary, model, groups = train(learnt, counts, n, "id", "t")
    shared = documents.sparkSession.sparkContext.broadcast((vocabulary, model, groups))
    kind = own.schema["id"].dataType.simpleString()
    parts = own.mapInArrow(_scored(shared), f"row long, id {kind}, token binary, n long, tokens long, known long, base double, score double")
    c = F.coalesce("c", F.lit(0))
    rare = F.col("n") * F.log10(c + 1)
    met = parts.join(counts.select("token", F.col("n").alias("c")), "token", "left")
    docs = met.groupBy("row").agg(F.max("id").alias("id"), F.sum("tokens").alias("n_tokens"), (F.sum("known") + F.sum(F.when(c > 0, F.col("n")).otherwise(0))).alias("n_known"), (F.sum("base") + F.sum(rare)).alias("base"), (F.sum("score") + F.sum(rare)).alias("score"))
    base = F.col("base") + math.log10(ends + 1) - F.col("n_tokens") * math.log10(n + v + 1)
    return docs.select(F.col("id").alias(doc_id), held_out(F.col("id"), FOLDS, HELD).alias("held_out"), "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
