"""Small fixtures against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import chat, decontaminate, jpeg, langid, license, lm, media, mixing, neardup, quality, tokens

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def blanks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abdeilnorstu", k=rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(60)]
    near = [" ".join(w if rng.random() > 0.02 else "x" + w for w in t.split()) for t in base[:30]]
    return [*base, *near, *base[:5], None, "", "  \n", "É Ü", " ".join(rng.choices(vocabulary, k=20_000)), "one two", "one two"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 9 == 0 else "en" if i % 2 else "fr", None if i % 11 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND).withColumns({"w": F.lit(1), "token": F.lit("x"), "items": F.lit(2), "row": F.lit(0)}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_op1(spark, docs, texts, empty):
    items = [(1, " ".join(words(texts[0])[:40])), (10, " ".join(words(texts[70])[3:30]) + " NEW words"), (2, "one Two"), (3, None), (None, texts[5]), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated_spans(docs, bench).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        hit, ids = set(), set()
        for item, text in items:
            if item is None:
                continue
            own = words(text)
            for s in range(max(len(own) - 13, 0) + 1 if own else 0):
                win = own[s : s + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids.add(str(item))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(ids)), i
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_op1_edges(spark, docs, texts, empty):
    bench = spark.createDataFrame([(1, "one two"), (2, " ".join(words(texts[0])[:20]))], "item_id long, text string")
    assert decontaminate.contaminated_spans(empty, bench.limit(0)).count() == 0
    twice = docs.unionByName(docs.limit(7))
    got = decontaminate.contaminated_spans(twice, bench, block_bytes=1000)
    assert got.count() == len(texts) + 7 and got.columns[:3] == ["doc_id", "n_words", "n_hit"]


def test_op2(docs, texts, empty):
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*blanks(t), None])
    n, v = sum(counts.values()), len(counts)
    got = lm.score(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        own = [*blanks(texts[r["doc_id"]]), None]
        assert r["n_tokens"] == len(own) and r["train_tokens"] == n and r["n_known"] == sum(counts[t] > 0 for t in own)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)
        assert r["score"] < 0
    assert lm.score(empty).count() == 0


def test_op2_scores_are_those_of_the_model_whatever_the_layout(spark, docs, texts):
    learnt = docs.where(~langid.held_out(F.col("doc_id"), 7, 2))
    counts = {bytes(r["token"]): r["n"] for r in lm.token_counts(learnt).collect()}
    total = sum(counts.values())
    vocabulary, m, _ = lm.train(learnt, lm.token_counts(learnt), total)
    often = max(lm.LEAST, math.isqrt(total) // lm.OFTEN)
    words = sorted((t for t in counts if t and len(t) <= lm.LONGEST and counts[t] >= often), key=lambda t: (-counts[t], t))
    assert len(words) == vocabulary.own > 20 and len(words) <= lm.OFTEN * math.sqrt(total)
    groups = max(8, math.isqrt(len(words)))
    group_of = lambda t: 1 + zlib.crc32(t[-2:]) % groups
    unit = {t: 1 + groups + i for i, t in enumerate(words)}
    inside = [sum(counts[t] + 1 for t in counts if t and t not in unit and group_of(t) == g + 1) + 1 for g in range(groups)]
    cluster = {w: c for c in range(len(vocabulary.edge) - 1) for w in range(vocabulary.edge[c], vocabulary.edge[c + 1])}
    assert sorted(cluster) == list(range(len(words)))
    one, two = spark.createDataFrame(docs.orderBy("doc_id").collect(), docs.schema).repartition(1), docs.repartition(7)
    got, again = ({r["doc_id"]: r["score"] for r in lm.score(d).collect()} for d in (one, two))
    for i in list(got)[:40]:
        tokens = lm.tokens_of((texts[i] or "").encode())
        units = [lm.END] * lm.CONTEXT + [unit.get(t, group_of(t)) for t in tokens] + [lm.END]
        want = 0.0
        for k in range(lm.CONTEXT, len(units)):
            q = np.append(sum(m.context[units[k - lm.CONTEXT + j]].astype(float) * m.scale[j] for j in range(lm.CONTEXT)), 1)
            own = units[k] - 1 - groups
            scores = m.output.astype(float) @ q
            want += (scores[units[k] if own < 0 else 1 + groups + cluster[own]] - np.log(np.exp(scores).sum())) / math.log(10)
            if own >= 0:
                members = [w for w in cluster if cluster[w] == cluster[own]]
                scores = m.word[members].astype(float) @ q
                want += (scores[members.index(own)] - np.log(np.exp(scores).sum())) / math.log(10)
        want += sum(math.log10((counts.get(t, 0) + 1) / inside[group_of(t) - 1]) for t in tokens if t not in unit)
        assert got[i] == pytest.approx(want, rel=1e-4) and got[i] == pytest.approx(again[i], rel=1e-6)


def _lm_parts(counts):
    vocabulary = lm.Vocabulary(counts, len(counts))
    clusters = np.add.reduceat(vocabulary.count, vocabulary.edge[:-1])
    noise = lm.Noise(vocabulary, np.concatenate([[50], np.full(vocabulary.groups, 5), clusters]))
    return vocabulary, noise, lm.start(vocabulary, noise)


def test_op2_probabilities_sum_to_one_and_learn():
    rng = np.random.default_rng(0)
    vocabulary, noise, m = _lm_parts([(b"w%d" % i, 400 - i) for i in range(300)])
    squares, met = lm.Model(*[np.zeros_like(x) for x in m]), lm.Model(*[np.zeros(len(x), np.int64) for x in m])
    cycle = np.resize(1 + vocabulary.groups + np.arange(0, 300, 60), 5000)  # five tokens, each after another
    seen, target = lm.positions(cycle.astype(np.int32))
    before = lm.log_probabilities(m, vocabulary, seen, target).mean()
    for _ in range(200):
        i = rng.integers(0, len(target), 512)
        lm.step(m, vocabulary, noise, seen[i], target[i], squares, met, rng)
    assert lm.log_probabilities(m, vocabulary, seen, target).mean() > before + 1
    every = np.arange(vocabulary.units)
    for context in seen[:20]:
        assert np.exp(lm.log_probabilities(m, vocabulary, np.tile(context, (len(every), 1)), every)).sum() == pytest.approx(1, abs=1e-4)
    never = np.setdiff1d(np.arange(vocabulary.units), [*np.unique(seen)])
    assert (met.context[never] == 0).all() and (m.context[never] == lm.start(vocabulary, noise).context[never]).all()


def test_op2_noise_is_drawn_by_counts_inside_a_cluster():
    vocabulary, noise, _ = _lm_parts([(b"w%d" % i, 1000 // (i + 1)) for i in range(100)])
    for c in (0, 3, len(vocabulary.edge) - 2):
        lo, hi = vocabulary.edge[c : c + 2]
        drawn = noise.inside(np.full(20_000, c), 1, np.random.default_rng(c)).ravel()
        assert drawn.min() >= lo and drawn.max() < hi
        share = vocabulary.count[lo:hi] / vocabulary.count[lo:hi].sum()
        assert np.allclose(np.bincount(drawn - lo, minlength=hi - lo) / 20_000, share, atol=0.02)


def test_op2_vocabulary_grows_with_the_corpus_and_long_tokens_are_joined(spark):
    def size(times):
        text = " ".join(f"w{i}" for i in range(1, 400) for _ in range(1 + times * 40 // i))
        rows = [(i, text) for i in range(3)] + [(100, ("x" * 5000 + " ") * 9)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        counts = lm.token_counts(docs)
        vocabulary, _, _ = lm.train(docs, counts, counts.agg(F.sum("n")).first()[0])
        assert all(len(t) <= lm.LONGEST for t in vocabulary.index)
        return vocabulary.own, {r["doc_id"]: r["n_known"] for r in lm.score(docs).collect()}[100]

    (few, known), (many, _) = size(1), size(60)
    assert many > few > 0 and known == (0 if zlib.crc32(b"100") % 7 == 2 else 9) + 1


def test_op2_without_any_frequent_token_and_without_training_texts(spark):
    rows = [(i, f"a{i} b{i} c") for i in range(4)] + [(None, None)]
    for d in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(2, "a b"), (None, "")], "doc_id long, text string")):
        got = lm.score(d).collect()
        assert len(got) == d.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_op2_slices_hold_every_training_text_once(docs):
    def held(frame, slices):
        return sorted((k, r["t"] or "") for k in range(slices) for r in lm.dealt(frame, "doc_id", "text", 3, k, slices).collect())

    four = held(docs, 4)
    assert four == held(docs.repartition(5), 4) and sorted(t for _, t in four) == sorted(t for _, t in held(docs, 1))


def _ppm(samples, order, text):
    """Bits of a text by counting contexts directly."""
    stats = {}
    for s in samples:
        s = bytes(order) + s
        for i in range(order, len(s)):
            for o in range(order + 1):
                stats.setdefault((o, s[i - o : i]), Counter())[s[i]] += 1
    bits, t = 0.0, bytes(order) + text
    for i in range(order, len(t)):
        for o in range(order, -2, -1):
            if o < 0:
                bits += 8
                break
            c = stats.get((o, t[i - o : i]))
            if not c:
                continue
            total = sum(c.values()) + len(c)
            if c[t[i]]:
                bits += math.log2(total / c[t[i]])
                break
            bits += math.log2(total / len(c))
    return bits


def test_op3_code_lengths_are_exact():
    samples = {"a": [b"the cat sat on the mat", b"the hat"], "b": ["äöü über".encode(), b"und der hut"]}
    grams = {}
    for lang, ts in samples.items():
        c = Counter(int.from_bytes((b"\0\0\0" + t)[i : i + 4], "big") for t in ts for i in range(len(t)))
        grams[lang] = (np.array(sorted(c)), np.array([c[k] for k in sorted(c)], float))
    model = langid.build(["a", "b"], grams)
    texts = [b"the mat", "über dem hut".encode(), b"", b"\xff\x01zq" * 5, b"x" * 3000]
    want = [[_ppm(samples[g], 3, t) for g in "ab"] for t in texts]
    assert np.allclose(langid.code_lengths(texts, model), want, rtol=1e-5, atol=1e-3)


def test_op3(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(real, langid.train(real), keep=["doc_id", "lang"])
    held = found.where(langid.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.98
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert got[95]["lang_pred"] == got[96]["lang_pred"] == got[97]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(empty) is None and langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert langid.in_known_language(docs).columns == docs.columns


def test_op4(docs, texts, empty):
    rows = mixing.mix(docs).collect()
    size = {i: len(blanks(t)) for i, t in enumerate(texts)}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), sum(sizes.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            free.discard(s)
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in size if source[i] == s) / 2 + 1
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, rows)) and mixing.mix(empty).count() == 0
    assert set(mixing.mixed_documents(docs).columns) == {*docs.columns, "repeats"}


def test_op5(docs, texts, empty):
    with open(tokens.VOCABULARY, "rb") as f:
        encode = tokens.encoding(f.read()).encode_ordinary
    lengths = sorted(len(encode(t or "")) for t in texts)
    got = tokens.context_limits(tokens.length_histogram(docs))
    for r in got.collect():
        limit = r["n_tokens"]
        assert r["docs"] == lengths.count(limit) and r["docs_over"] == sum(x > limit for x in lengths)
        assert r["truncated_tokens"] == sum(min(x, limit) for x in lengths) and r["tokens_within"] == sum(x for x in lengths if x <= limit)
    assert [r["n_tokens"] for r in tokens.quantiles(got, [0.5, 1.0]).collect()] == [lengths[math.ceil(len(lengths) / 2) - 1], lengths[-1]]
    assert tokens.context_limits(tokens.length_histogram(empty)).count() == 0


def test_op6(spark):
    calls = [(1, "a", 1, "f", '{"y": 2, "x": "é"}', []), (1, "b", 2, "f", '{"x": 1}', ["a", "gone"]), (1, "c", 3, "g", "{}", ["d"]), (1, "d", 4, "f", "no json", ["c"]), (1, "a", 9, "f", "{}", None), (None, "z", 0, "f", "{}", None)]
    results = [(1, "a", 2, "first"), (1, "a", 5, "second"), (1, "q", 6, "lost")]
    schema = spark.createDataFrame([("f", "x", "STRING", True), ("f", "y", "BIGINT", False)], chat.SCHEMA)
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    got = {x["call_id"]: x for x in chat.link_tool_calls(c, r, schema).collect()}
    assert set(got) == {"a", "b", "c", "d", "q"}
    assert (got["a"]["status"], got["a"]["n_calls"], got["a"]["n_results"], got["a"]["valid"], got["a"]["level"]) == ("linked", 2, 2, True, 0)
    assert got["a"]["message"] == '{"arguments":{"x":"é","y":2},"id":"a","name":"f","result":"first"}' and json.loads(got["a"]["message"])
    assert (got["b"]["level"], got["b"]["n_missing"], got["b"]["errors"]) == (1, 1, ["x: bigint for string"])
    assert got["c"]["level"] is None and got["d"]["level"] is None and got["c"]["errors"] == ["g: no such function"] and got["d"]["errors"] == ["arguments: not an object", "x: missing"][:1]
    assert got["q"]["status"] == "orphan" and got["q"]["message"] is None
    assert chat.link_tool_calls(c.limit(0), r.limit(0), schema).count() == 0


def test_op7(spark, docs, empty):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(real, labels).join(labels, "doc_id")
    right, good, kept = got.agg(F.avg((F.col("good") == (F.col("quality") == 1)).cast("double")), F.count_if(F.col("quality") == 1), F.count_if((F.col("quality") == 1) & F.col("good"))).first()
    assert right > 0.95 and kept > 0.97 * good
    assert quality.classify(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert quality.classify(empty, labels).count() == 0 and quality.good_documents(docs, labels).columns == docs.columns


def test_op8(docs, texts, empty):
    for r in media.text_media(docs).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = media.padded(raw)
        file = media.write_bytes(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(payload) % 64 == 0 and len(payload) >= 64 and r["media_sha256"] == hashlib.sha256(file).hexdigest()
    assert media.text_media(empty).count() == 0
    assert media.media_clips(docs.select("doc_id", F.lit(b"junk").alias("media")).limit(1)).first()["error"]


def test_op8_frames_and_shots(monkeypatch):
    payload = bytes(range(256)) * 3
    avi = media.read_avi(media.write_bytes(payload))
    fast = jpeg.decode(avi.frames[0])
    parse = jpeg._parse
    monkeypatch.setattr(jpeg, "_parse", lambda h: parse(h)._replace(fast=False))
    assert (jpeg.decode(avi.frames[0]).luma == np.kron(fast.blocks, np.ones((8, 8)))).all()
    assert media.shots(np.array([[1.0, 0], [1, 0], [0, 1], [0, 1]])) == [(0, 1), (2, 3)] and media.shots(np.zeros((0, 2))) == []


def test_op9(docs, texts, spark, empty):
    extra = ["Under the MIT License; under the mit license.", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND ISC", "CC BY-NC 4.0, Apache License, Version 2.0", "under the mit"]
    own = spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string")
    got = [r for r in sorted(license.scan_licenses(own).collect(), key=lambda r: r["doc_id"])]
    assert [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == [(2, 0, 4, "mit"), (0, None, None, ""), (2, 0, 5, "apache-2,cc-by-nc"), (0, None, None, "")]
    assert got[1]["labels"] == "gpl-2.0-only,isc,mit" and got[1]["permissive"] and got[3]["score"] == 0
    assert license.evaluate("MIT AND GPL-3.0 OR ISC")[1] and not license.evaluate("(MIT OR ISC) AND GPL-3.0")[1]
    assert {r["doc_id"]: r["n_words"] for r in license.scan_licenses(docs).collect()} == {i: len(words(t)) for i, t in enumerate(texts)} and license.scan_licenses(empty).count() == 0


def brute_components(texts, k):
    sets = []
    for t in texts:
        w = blanks(t)
        m = min(k, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_op10(docs, texts, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, shingle=4).collect()}
    assert got == brute_components(texts, 4)
    assert neardup.near_duplicates(empty).count() == 0
    once = neardup.one_of_each(docs.unionByName(docs.limit(3)), shingle=4)
    assert once.columns == docs.columns and once.where("doc_id < 3").count() == len({got[i][1] for i in range(3)})


def test_op10_large_family(spark):
    """More copies than a small bucket holds, many of them too far from the middle to link with it."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(70):
        t = list(base)
        for i in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3, 4])):
            t[i] = f"e{rng.randint(0, 40)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, shingle=4).collect()}
    assert got == brute_components(texts, 4)
