"""Co-training against the same rounds over all rows at once, in plain numpy, and its edges."""

import random

import numpy as np

from attestra.llm import quality

KIND = "doc_id long, text string, lang string, source string, c long, y string"


def rows(n=600, seed=2):
    rng = random.Random(seed)
    good, bad = ["river", "stone", "winter", "field", "letter"], ["buy", "click", "$$$", "now", "free"]
    out = []
    for i in range(n):
        q = rng.random() < 0.7
        words = rng.choices((good if q else bad) + ["the", "of"], k=rng.randint(5, 60))
        out.append((i, " ".join(words), rng.choice(["en", "fr"]), ("lib" if q else "ads") if rng.random() < 0.8 else None, 1, "x"))
    marks = [(i, int(r[3] == "lib"), 0) for i, r in enumerate(out) if r[3] is not None and i % 3 == 0]
    return [*out, (n, None, None, None, 1, "x"), (n + 1, "", "en", "lib", 1, "x"), (None, "river " * 20_000, "en", "lib", 1, "x"), out[5], out[6]], marks


def tables(spark):
    docs, marks = rows()
    return spark.createDataFrame(docs, KIND).repartition(5), spark.createDataFrame(marks, "doc_id long, quality long, toxic long")


def test_same_as_over_all_rows_at_once(spark):
    docs, labels = tables(spark)
    found = quality.features(docs, labels)
    model = quality.train(found)
    local = sorted(found.selectExpr("xxhash64(id) as turn", "cast(id as string) as id", "c", "m", "y", "chosen").collect(), key=lambda r: (r["turn"], r["id"] or "", r["y"] or 0))
    assert all(r["chosen"] == (r["y"] is not None) for r in local)
    marked, rest = [r for r in local if r["chosen"]], [r for r in local if r["y"] is None]
    assert len(rest) > 400 and len(marked) > 100
    side = lambda own: (np.array([r["c"] for r in own]), np.array([r["m"] for r in own]))
    want = quality.co_train((*side(marked), np.array([r["y"] for r in marked])), lambda teachers, pupils: quality.pseudo_sums(teachers, pupils, side(rest)))
    for a, b in ((model.content, want.content), (model.metadata, want.metadata)):
        assert np.allclose(a.weights, b.weights, atol=1e-6)
    assert np.allclose(model.mix, want.mix, atol=1e-5)
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert sum(got[i]["good"] == (s == "lib") for i, s in truth.items() if s) > 0.95 * sum(s is not None for s in truth.values())


def test_a_step_is_newton_on_all_rows():
    """With the same rows, a labelled and a pseudo-labelled half move a view as one labelled set of both would."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 4)), np.tile([0.0, 1.0], 40)
    view = quality.View(np.zeros(4), np.ones(4), rng.normal(size=5) / 5)
    sure = quality.View(np.zeros(1), np.ones(1), np.array([0.0, 1.0]), low=-1, high=1)
    total = quality.pseudo_sums((sure, view), (sure, view), (np.where(y, 2.0, -2.0)[:, None], x))
    n = quality._length(1)
    m = quality._length(4)
    part = total[2 * n :]
    assert part[0] == part[m] == 40
    one = quality._moved(view, x, y, (part[:m], part[m:]))
    both = quality._moved(view, np.concatenate([x, x]), np.concatenate([y, y]), ())
    assert np.allclose(one.weights, both.weights)


def test_confidence_is_held_out_precision():
    view = quality.View(np.zeros(1), np.ones(1), np.array([0.0, 1.0]))
    z = np.linspace(-2, 2, 401)
    y = (z > 0).astype(float)
    y[300] = 0  # one error above z = 1
    got = quality._trusted(view, z[:, None], y)
    low = max(b for b in z if (z <= b).sum() >= quality.WITNESSES and (y[z <= b] == 0).mean() >= quality.TRUST)
    high = min(b for b in z if (z >= b).sum() >= quality.WITNESSES and (y[z >= b] == 1).mean() >= quality.TRUST)
    assert (got.low, got.high) == (low, high)
    assert quality._trusted(view, z[:, None], _alternating(z)).high == np.inf


def _alternating(z):
    return (np.arange(len(z)) % 2).astype(float)


def test_edges(spark):
    docs, labels = tables(spark)
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add((r["content_score"], r["metadata_score"], r["score"]))
    assert len(by_id[5]) == len(by_id[6]) == 1
    empty = docs.limit(0)
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {0.5}
    nothing = labels.selectExpr("cast(null as long) as doc_id", "quality", "toxic")
    assert quality.classify(docs, nothing).where("score <> 0.5").count() == 0
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    want = sorted(str(r["doc_id"]) for r in got if r["good"])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_rows_of_one_labelled_id_come_to_the_driver_once(spark, monkeypatch):
    """However many rows labelled ids have, the driver gets a bounded number."""
    from pyspark.sql import functions as F

    docs, labels = tables(spark)
    hot = labels.first()["doc_id"]
    many = docs.unionByName(docs.where(F.col("doc_id") == hot).limit(1).withColumn("text", F.lit("short")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100_000)))).drop("n"))
    seen = []
    real = quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda learnt, sums: seen.append(len(learnt[2])) or real(learnt, sums))
    rows = quality.features(many, labels)
    ids = rows.where("chosen").select("id").distinct().count()
    quality.train(rows)
    assert rows.where("chosen").count() > 100_000 and seen == [ids]
