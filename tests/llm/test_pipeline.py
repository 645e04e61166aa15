"""The corpus pipeline's stages, and its run from end to end, against brute force on a small corpus."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import langid, mixing, neardup, quality
from brute import components, contaminated

KIND = "doc_id long, text string, lang string, source string, n_chars long, _id long, _h string, _bad_id long, b_token int, h string, times int"
SPEECH = {"en": "the river and stone of winter were in a field that he saw with her", "fr": "la rivière est dans une forêt avec des pierres où nous étions très heureux", "de": "der fluß und die steine im winter waren für ihn schön über das feld"}


def corpus():
    rng = random.Random(11)
    words = {g: sorted({*s.split(), *(w[::-1] for w in s.split())}) for g, s in SPEECH.items()}
    passage = " ".join(rng.choices(words["en"], k=40))
    rows, marks = [], []

    def add(text, lang, source, doc_id=-1):
        rows.append((len(rows) if doc_id == -1 else doc_id, text, lang, source, len(text or ""), 0, "h", None, 2, None, 3))
        return rows[-1][0]

    for k in range(150):
        g = rng.choice(sorted(words))
        bad = k % 6 == 0
        text = " ".join(rng.choices(["buy", "now", "$$$", "!!!"], k=rng.randint(15, 60)) + rng.choices(words[g], k=4) if bad else rng.choices(words[g], k=rng.randint(15, 80)))
        i = add(text, g, "ads" if bad else f"s{k % 3}")
        if k % 2 == 0:
            marks.append((i, int(not bad), 0))
    good = [r for r in rows if r[3] != "ads"]
    for r in good[:20]:
        add(r[1], r[2], r[3])  # copies
    for r in good[20:40]:
        add(r[1] + " again", r[2], r[3])
    for k in range(6):
        add(" ".join(rng.choices(words["en"], k=8)) + " " + passage[: 60 + 20 * k] + " " + " ".join(rng.choices(words["en"], k=20)), "en", "s1")
    add(None, None, None)
    add("", "en", "s0")
    add("12 34 --", "en", "s0")
    add(good[50][1], "en", "s2", None)  # without id: a copy, and a text of its own
    add(" ".join(rng.choices(words["fr"], k=30)), "fr", "s2", None)
    add(" ".join(rng.choices(words["de"], k=30)), "de", None, 3)  # an id twice
    rows.append(rows[7])
    add(" ".join(rng.choices(words["en"], k=4000)), "en", "s1")
    return rows, marks, [(1, passage), (2, "one two"), (None, passage), (3, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows, marks, items = corpus()
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality long, toxic long").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def bag(rows):
    return Counter(tuple(r) for r in rows)


def expected(spark, name, docs, at):
    """What the stage should leave of docs: each document judged by itself, or by brute force over all."""
    rows = [tuple(r) for r in docs.collect()]
    if name == "language_id":
        found = langid.identify(docs, langid.train(docs), keep=docs.columns).where("lang_pred <> 'und' and score >= 0.5")
        kept = bag(found.select(*docs.columns).collect())
        letters = bag(r for r in rows if any(c.isalpha() for c in r[1] or ""))
        assert not kept - letters and sum(kept.values()) > 0.95 * sum(letters.values())
        return [kept]
    if name == "quality_classifier":
        rows_of = quality.features(docs, spark.read.parquet(f"{at}/labels.parquet"))
        model = quality.train(rows_of)
        return [bag(r for r in rows if quality.scores(model, *quality._features([(r[1] or "").encode()], [r[3]], [r[2]]))[2][0] >= 0.5)]
    if name == "minhash_neardup":
        at_ = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
        roots = components([rows[i][1] for i in at_], 5)
        first = {}
        for place, i in enumerate(at_):
            first.setdefault((roots[place], "") if rows[i][1] and rows[i][1].split() else ("alone", i), rows[i])
        return [bag(first.values())]
    if name == "benchmark_decontamination":
        items = [tuple(r) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
        return [bag(r for r in rows if not contaminated(r[1], items))]
    taken = Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["size"]})
    return [bag((*r, taken[r[0]]) for r in rows if (r[1] or "").split() and taken[r[0]])]


def test_each_stage_and_the_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        got = bag(docs.collect())
        assert got in expected(spark, name, before, folder), name
        assert docs.columns == [*before.columns, *(["repeats"] if name == "source_mixing" else [])]
        counts.append(sum(got.values()))
    assert all(a > b for a, b in zip(counts[:4], counts[1:5], strict=True)), counts  # the first four stages all drop some
    assert bag(corpus_pipeline.run(spark, folder).collect()) == got


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name


def test_large_buckets_are_refined_alike_at_every_bound(spark, monkeypatch):
    """Whatever counts as a small bucket, the groups are those of brute force."""
    rng = random.Random(9)
    base = [[f"{g}{i}" for i in range(60)] for g in "ab"]
    base.append(base[0][:45] + base[1][45:])
    texts = []
    for _ in range(90):
        t = list(rng.choice(base))
        for i in rng.sample(range(60), rng.choice([0, 1, 2, 3, 4])):
            t[i] = f"e{rng.randint(0, 30)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components(texts, 4)
    for small in (1, 5, 1000):
        monkeypatch.setattr(neardup, "SMALL", small)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, shingle=4).collect()}
        assert got == want, small
