"""Metrics of real records: the gram filter loses nothing, sends few lines on, and the answers for records that lack parts."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.functions.fuzzy import may_reach, partial_ratio
from attestra.functions.numbers import shortest
from attestra.operators import real

KIND = "item_id long, beverage_type string, brand string, class_desc string, applicant string, origin_desc string, domestic string"
LINE = "item_id long, image_index int, line_seq int, text string, box array<struct<x:double,y:double>>"


@pytest.mark.parametrize("least", [90, 80, 65])
def test_gram_filter_loses_nothing(spark, least):
    rng = random.Random(least)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choices("abcd ", k=rng.randint(0, 14)))
        b = list("".join(rng.choices("abcd ", k=rng.randint(0, 6))) + a + "".join(rng.choices("abcd ", k=rng.randint(0, 6))))
        for _ in range(rng.randint(0, 3)):
            if b:
                at = rng.randrange(len(b))
                b[at : at + 1] = rng.choice(["", "x", b[at] + "y"])
        pairs.append((a, "".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", may_reach(F.col("a"), F.col("b"), least).alias("may")).collect()
    reached = [r for r in rows if partial_ratio(r["a"], r["b"]) >= least]
    assert len(reached) > 100 and all(r["may"] for r in reached)


def _lines(rows):
    return [(i, 0, k, t, [(0.0, 50.0 * k), (100.0, 50.0 * k), (100.0, 50.0 * k + 40), (0.0, 50.0 * k + 40)]) for i, texts in rows.items() for k, t in enumerate(texts)]


def test_few_lines_are_scored(spark):
    """The plan scores what passes the filter: of 2,000 lines, those that hold the name or nearly."""
    rng = random.Random(3)
    rows = {i: ["".join(rng.choices("bcdfghjklmnopqrstuvwxyz ", k=30)) for _ in range(9)] + ["product of frnce" if i % 2 else "wine"] for i in range(200)}
    lines = spark.createDataFrame(_lines(rows), LINE)
    records = spark.createDataFrame([(i, "wine", "B", "C", "", "France", "no") for i in range(200)], KIND)
    found = real.origins_read(records, lines)
    assert {(r["item_id"] % 2, r["origin_found"]) for r in found.collect()} == {(0, False), (1, True)}
    pairs = records.select("item_id", F.lower("origin_desc").alias("c")).join(lines, "item_id")
    assert pairs.where(may_reach(F.col("c"), F.col("text"), 90)).count() <= 120
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and "ArrowEvalPython" in plan


def test_metrics_of_records_that_lack_parts(spark):
    records = spark.createDataFrame([(1, "wine", None, " ", None, None, "no"), (2, "malt", "Blue", "Ale", "Oak Co | Salem, OR", "Peru", "no"), (3, "wine", "Red", "Wine", "", "Peru", "yes")], KIND).withColumn("score", F.lit(1))
    lines = spark.createDataFrame(_lines({2: ["BLUE", "Made in per u", None], 3: ["peru"]}), LINE)
    got = {r["item_id"]: r for r in real.metrics(records, lines).collect()}
    assert got[1]["brand"] is None and got[1]["class"] is None and got[1]["applicant"] is None and got[1]["origin_found"] is None and got[1]["n_lines"] == 0 and not got[1]["located"]
    assert got[2]["brand"] == "match" and got[2]["origin_found"] is False and got[2]["applicant"] == "needs_review" and got[2]["n_lines"] == 2
    assert got[3]["origin_found"] is None and got[3]["imported"] is False
    assert real.metrics(records.limit(0), lines).count() == 0 and real.metrics(records, lines.limit(0)).count() == 3


def test_shortest(spark):
    values = [750.0, 12.5, 0.0, 1e6, 1234567.0, 999999.5, 0.0001, 0.00001234, 1 / 3, -2.50, 100.0, 1e-300, 1e22]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", shortest(F.col("v")).alias("s")).collect()
    assert [(r["v"], r["s"]) for r in rows] == [(v, f"{v:g}") for v in values]
