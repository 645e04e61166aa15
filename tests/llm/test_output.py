"""Resampling, token files and whitening against brute force."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from attestra.llm import resample, tokenfiles, whiten

KIND = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abdeilnorstu", k=rng.randint(2, 7))) for _ in range(300)]
    some = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(150)]
    odd = [None, "", " \n\t", "É Ü ß 'S don't WE'LL", "#hash <|endoftext|> x\x7fy \x7f", "a\x1fb c d é ́f ΣΑΣ", "x" * 70_000, " ".join(rng.choices(vocabulary, k=20_000)), "one two", "one two"]
    return [*some, *odd, *some[:6]]


def _gumbel(seed, doc_id):
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _resampled(rows, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    def grams(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for b in grams(x):
            s[b] += 1
    for x in target:
        for b in grams(x):
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        g = grams(x)
        weight = sum(gain[b] for b in g)
        out.append([i, len(g), weight, weight + _gumbel(seed, i), None])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


def test_resample(spark, texts):
    rows = [(None if i == 7 else i // 2 if i > 150 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, KIND).repartition(5).withColumns({"row": F.lit(1), "bucket": F.lit("x"), "rank": F.lit(0), "id": F.lit(3)})
    target = [texts[3], None, "new words " + (texts[9] or ""), ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for options in ({}, {"longest": 3, "buckets": 97, "least": 5, "percent": 40, "seed": 1}):
        named = {"least_words" if k == "least" else k: v for k, v in options.items()}
        got = resample.resample(docs, bench, **named)
        assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
        assert sorted(map(tuple, got.collect()), key=str) == _resampled(rows, target, **options)
    drawn = resample.drawn_documents(docs, bench)
    assert sorted(r["rank"] for r in drawn.collect()) == list(range(1, drawn.count() + 1))


def test_resample_edges(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], KIND)
    none = docs.limit(0)
    assert resample.resample(none, docs).count() == 0
    got = resample.resample(docs, none).collect()
    assert sorted(map(tuple, got), key=str) == _resampled(list(enumerate(texts)), [])
    same = spark.createDataFrame([(1, " ".join(["w"] * 30))] * 40, KIND)  # ties throughout: ranks stay distinct
    assert sorted(r["rank"] for r in resample.resample(same, docs).collect() if r["rank"]) == [1, 2, 3, 4]
    assert {r["n_features"] for r in resample.resample(spark.createDataFrame([(1, None), (2, "")], KIND), docs).collect()} == {0}


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfiles.vocabulary_path())


@pytest.mark.parametrize("by_words", [True, False])
def test_token_files(spark, texts, tmp_path, by_words):
    ids = [None if i == 4 else -i if i % 3 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), KIND).repartition(3).withColumns({"h": F.lit(1), "row": F.lit(2), "t": F.lit("x"), "name": F.lit("y")})
    folder = f"{tmp_path}/tokens"
    tokenfiles.write_tokens(docs, folder, by_words=by_words, part_bytes=40_000)
    whole = _tokenizer()
    want = {}
    for i, t in zip(ids, texts, strict=True):
        want.setdefault(i, []).append([*whole.encode(t or "", add_special_tokens=False).ids, 2])
    got = tokenfiles.read_tokens(spark, folder).collect()
    assert len(got) == len(texts)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        want[r["doc_id"]].remove(r["ids"])
        at += r["n_tokens"]
    assert not any(want.values())
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    loader = tokenfiles.TokenFiles(folder)
    assert len(loader) == len(texts) and len(loader.parts) > 1
    for i, r in enumerate(sorted(got, key=lambda r: r["start"])):
        assert loader.document(i).tolist() == r["ids"]
    every = [x for r in sorted(got, key=lambda r: r["start"]) for x in r["ids"]]
    assert loader.ids(0, 1 << 40).tolist() == every and loader.ids(50, 9000).tolist() == every[50:9000]


def test_token_files_edges(spark, tmp_path):
    none = spark.createDataFrame([], KIND)
    tokenfiles.write_tokens(none, f"{tmp_path}/none")
    assert tokenfiles.read_tokens(spark, f"{tmp_path}/none").count() == 0 and len(tokenfiles.TokenFiles(f"{tmp_path}/none")) == 0
    one = spark.createDataFrame([("b\n\"x", "text"), ("a", None), ("a", None)], "name string, body string")
    tokenfiles.write_tokens(one, f"{tmp_path}/one", "name", "body", end=49407)
    got = tokenfiles.read_tokens(spark, f"{tmp_path}/one", "string", "name").collect()
    assert sorted((r["name"], r["start"], r["ids"][-1]) for r in got) == [("a", 0, 49407), ("a", 1, 49407), ("b\n\"x", 2, 49407)]


def test_remote_bytes(texts):
    """Files that only Spark reaches come as bytes and give the same rows as memory maps."""
    import pyarrow as pa

    ids, starts = np.array([5, 2, 7, 8, 2], "<u2"), np.array([10, 12], "<i8")
    row = {"width": 2, "base": 10, "n": 5, "tokens": ids.tobytes(), "offsets": starts.tobytes(), "names": b'{"id":1}\n{"id":4}\n'}
    out = next(tokenfiles._documents(True)(iter([pa.RecordBatch.from_pylist([row])]))).to_pylist()
    assert [(r["name"], r["start"], r["ids"]) for r in out] == [('{"id":1}', 10, [5, 2]), ('{"id":4}', 12, [7, 8, 2])]


VECTOR = "vec_id long, embedding array<float>"


def test_whitening(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(3, base[3].tolist()), (None, base[5].tolist())]
    bad = [(900, None), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (902, [math.inf] + [0.0] * 5), (903, [math.nan] * 6), (904, [1.0]), (905, [])]
    table = spark.createDataFrame(rows + bad, VECTOR).repartition(4).withColumns({"n": F.lit(1), "at": F.lit(2), "id": F.lit(9)})
    got = whiten.whiten(table, components=4).collect()
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 1_000_000
    n, S = len(x), x.sum(0)
    V = np.array([[float(Fraction(int(n * (x[:, i].astype(object) * x[:, j]).sum() - int(S[i]) * int(S[j])), n * n)) for j in range(6)] for i in range(6)])
    e, u = np.linalg.eigh(V)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * 4 and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    dev = {}
    for i, v in zip([i for i, _ in rows], x, strict=True):
        dev.setdefault(i, int(((n * v - S).astype(object) ** 2).sum()))
        white = (v - S / n) @ u[:, :4] / np.sqrt(e[:4])
        own = [r for r in got if r["vec_id"] == i]
        for r in own:
            assert int(r["deviation"]) == dev[i]
            assert abs(abs(r["whitened"]) - abs(white[r["component"] - 1])) < 1e-6
            assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-9
    assert sum(r["vec_id"] == 3 for r in got) == 8 and sum(r["vec_id"] is None for r in got) == 4


def test_whitening_edges(spark):
    none = spark.createDataFrame([], VECTOR)
    assert whiten.whiten(none).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], VECTOR)
    got = {(r["vec_id"], r["component"]): r for r in whiten.whiten(flat).collect()}
    assert len(got) == 15 and got[1, 2]["whitened"] is None and got[1, 1]["whitened"] is not None and got[0, 1]["identity_error"] < 1e-9
    assert all(r["whitened"] is None for r in whiten.whiten(spark.createDataFrame([(1, [2.0, 3.0])] * 3, VECTOR)).collect())
    huge = [(0, [1e30, -1e30]), (1, [2e17, 5.0]), (2, [-3e15, 7.0]), (3, [0.0, 1e16])]
    wide = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    top = (1 << 63) - 1 - whiten.OFFSET
    x = [[max(-(1 << 63), min(top, math.floor(64 * c))) for c in v] for _, v in huge]
    sums = [sum(v[j] for v in x) for j in range(2)]
    for r in whiten.whiten(wide).collect():
        exact = sum((4 * x[r["vec_id"]][j] - sums[j]) ** 2 for j in range(2))
        assert r["deviation"] is None if exact >= 10**38 else int(r["deviation"]) == exact


def test_exact_products():
    rng = np.random.default_rng(1)
    for bits in (3, 20, 40, 62):
        y = rng.integers(-(1 << bits), 1 << bits, (50, 3))
        own = y.astype(object)
        assert (whiten.exact_products(y) == own.T @ own).all()
