"""The language model's products in numpy, against sums written out."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from attestra.llm import lm


def test_one_product_scales_and_adds_up_the_context():
    rng = np.random.default_rng(3)
    small = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    m = lm.Model(small(9, lm.WIDTH), small(lm.CONTEXT, lm.WIDTH), small(5, lm.WIDTH + 1), small(4, lm.WIDTH + 1))
    seen = rng.integers(0, 9, (20, lm.CONTEXT))
    q, met = lm.summed(m, seen)
    assert np.allclose(q[:, :-1], sum(m.context[seen[:, j]] * m.scale[j] for j in range(lm.CONTEXT)), atol=1e-5)
    assert (q[:, -1] == 1).all() and np.array_equal(met.reshape(20, lm.CONTEXT, -1), m.context[seen])


def test_shares_of_scores_past_the_range_of_float32():
    scores = np.array([[0, 1, 2], [200, 100, -300], [-500, -501, -502], [61, -61, 0]], np.float32)
    at = np.array([2, 1, 0, 1])
    want = [row[k] - np.logaddexp.reduce(row) for row, k in zip(scores.astype(float), at, strict=True)]
    assert np.allclose(lm._log_share(scores.copy(), at), want, rtol=1e-5)


def test_texts_are_split_counted_and_read_without_a_python_object_for_each_token(monkeypatch):
    draw, odd = random.Random(5), [9, 10, 11, 12, 13, 28, 31, 32, 32, 32, 0, 65, 97, 98, 0x85, 0xA0, 0xC2, 0xFF]
    texts = [None, b"", b" ", b"a", *(bytes(draw.choices(odd, k=draw.randrange(30))) for _ in range(500))]
    own = [lm.tokens_of(t) for t in texts]
    counts = Counter(t for ts in own for t in ts)
    frequent = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:40]
    vocabulary = lm.Vocabulary(frequent, 25)
    one_by_one = [lm.positions(np.array([vocabulary.unit[i] if (i := vocabulary.index.get(t, -1)) >= 0 else vocabulary.rare(t) for t in ts], np.int32)) for ts in own]
    monkeypatch.setattr(lm, "PIECE", 700)
    monkeypatch.setattr(lm, "HELD_TOKENS", 50)
    monkeypatch.setattr(lm, "tokens_of", None)
    column = pa.array([b"before", *texts], pa.binary())[1:]
    at, seen, target, others = 0, [], [], []
    for first, tokens, lengths in lm.pieces(column):
        assert first == at and tokens.to_pylist() == [t for ts in own[at : at + len(lengths)] for t in ts]
        at += len(lengths)
        places, units, rare = vocabulary.read(tokens)
        assert rare.to_pylist() == [t for t, i in zip(tokens.to_pylist(), places, strict=True) if i < 0]
        for found, x in zip((seen, target), lm.positions(units, lengths), strict=True):
            found.append(x)
        others += rare.to_pylist()
    assert at == len(texts) and len(seen) > 3 and Counter(others) == {t: n for t, n in counts.items() if t not in vocabulary.index}
    for got, want in zip((seen, target), zip(*one_by_one, strict=True), strict=True):
        assert np.array_equal(np.concatenate(got), np.concatenate(want))
    summed = Counter()
    for batch in lm._counted(iter([pa.RecordBatch.from_arrays([column], ["t"]), pa.RecordBatch.from_arrays([column[:0]], ["t"])])):
        summed.update({r["token"]: r["n"] for r in batch.to_pylist()})
    assert summed == counts + Counter({b"": len(texts)})
