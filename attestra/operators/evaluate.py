"""Evaluation: percentiles, tallies, rates and load figures over result tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import text_partial_ratio
from ..functions.text import key


#: Bins a doubling of the value.
FINE = 4096


def _bin(v: Column) -> Column:
    """A number that never falls as the value rises, the same for values within 1/FINE of a doubling."""
    size = F.floor(F.log2(F.abs(v)) * FINE) + 1100 * FINE
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def latency(rows: DataFrame, by: list[str], ms: str = "ms") -> DataFrame:
    """Cases, interpolated median and nearest-rank 95th percentile a group; rows without a time do not count.

    Distinct values are counted before anything is ordered. Counts of bins, whose number does not grow with the rows,
    say which bins hold the ranks asked for; only the values of those are ordered, so no group is sorted in one task.
    """
    v = F.col(ms).cast("double")
    per = rows.where(v.isNotNull()).groupBy(*by, v.alias("v")).agg(F.count("*").alias("c")).withColumn("bin", _bin(F.col("v")))
    group = Window.partitionBy(*by)
    bins = per.groupBy(*by, "bin").agg(F.sum("c").alias("b")).withColumn("n", F.sum("b").over(group)).withColumn("below", F.sum("b").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("b"))
    half = F.floor(F.col("n") / 2)
    ranks = {"low": F.when(F.col("n") % 2 == 0, half).otherwise(half + 1), "high": half + 1, "p95": F.ceil(0.95 * F.col("n")), "p95_upper": F.least(F.col("n"), F.floor(0.95 * F.col("n")) + 1)}
    asked = reduce(or_, [(k > F.col("below")) & (k <= F.col("below") + F.col("b")) for k in ranks.values()])
    held = bins.where(asked).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("bin").alias("_bin"), "n", "below")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("bin") == F.col("_bin")]
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*by, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    at = per.join(held, same).withColumn("upto", upto)
    found = at.groupBy(*by).agg(F.max("n").alias("cases"), *[F.min(F.when(F.col("upto") >= k, F.col("v"))).alias(f"_{name}") for name, k in ranks.items()])
    return found.select(*by, "cases", ((F.col("_low") + F.col("_high")) / 2).alias("p50"), F.col("_p95").alias("p95"), F.col("_p95_upper").alias("p95_upper"))


def field_rates(checks: DataFrame, by: str) -> DataFrame:
    """Per group and over all (null group): checks, each status, and the share of matches; absent checks do not count."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = checks.groupingSets([[F.col(by), F.col("check_id")], [F.col("check_id")]], by, "check_id")
    out = out.agg(F.count("*").alias("n"), n("match").alias("matched"), n("needs_review").alias("review"), n("mismatch", "not_found").alias("failed"))
    return out.withColumn("match_rate", F.col("matched") / F.col("n"))


def false_alarm_rate(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("checks"), F.count_if(F.col("status") != "match").alias("alarms"), F.avg((F.col("status") != "match").cast("int")).alias("rate"))


def warning_split(warnings: DataFrame) -> DataFrame:
    w = F.col("warning")
    wording = ~w["present"] | (w["assessment"] == "wording")
    return warnings.agg(F.count("*").alias("n"), F.count_if(w["exact"]).alias("exact"), F.count_if(w["present"] & ~w["exact"] & (w["assessment"] != "wording")).alias("noise"), F.count_if(wording).alias("wording_or_absent"))


def histogram(rows: DataFrame, c: str) -> DataFrame:
    """Counts, most frequent first, ties by value."""
    return rows.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c)


def by_variant(cases: DataFrame) -> DataFrame:
    per = cases.groupBy("variant", "verdict").agg(F.count("*").alias("n"))
    verdicts = per.groupBy("variant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n")))).alias("verdicts"))
    return latency(cases, ["variant"]).join(verdicts, "variant").select("variant", "cases", "verdicts", F.col("p50").alias("median_ms"))


def detected(cases: DataFrame) -> DataFrame:
    """Adds ``assessed`` and ``detected`` to cases (variant, statuses map, warning struct)."""
    w = F.col("warning")
    found = F.when(F.col("variant") == "wrong_abv", F.col("statuses")["alcohol_content"] == "mismatch").when(F.col("variant") == "titlecase", w["caps"] == "needs_review").when(F.col("variant") == "allbold", w["type_weight_reading"] == "same")
    found = found.when(F.col("variant") == "altered", w["assessment"] == "wording").when(F.col("variant") == "missing", ~w["present"])
    return cases.withColumn("detected", found).withColumn("assessed", F.col("variant") != "tiny")


def detection_rate(cases: DataFrame) -> DataFrame:
    return detected(cases).agg(F.count_if("assessed").alias("assessed"), F.count_if(F.col("assessed") & F.coalesce("detected", F.lit(False))).alias("found"), F.count_if(~F.col("assessed")).alias("not_assessed")).withColumn("rate", F.try_divide("found", "assessed"))


def tally(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))


def load_figures(requests: DataFrame, images_each: int = 1) -> DataFrame:
    """Of requests (status, wall_ms, refused): throughput over the run's span (at_ms to at_ms + wall_ms), percentiles
    of the served ones, codes and refusals. A request without a time counts and adds nothing to the times."""
    served = requests.where("status = 200")
    span = requests.agg(((F.max(F.col("at_ms") + F.coalesce("wall_ms", F.lit(0))) - F.min("at_ms")) / 1000).alias("wall_s"), F.count("*").alias("n"), F.sum("refused").alias("refused"), F.count_if(F.col("status") == 200).alias("served"))
    one = F.lit(1).alias("one")
    return span.select("*", one).join(latency(served.select("*", one), ["one"], "wall_ms"), "one", "left").select("n", "served", "refused", "wall_s", F.try_divide("served", "wall_s").alias("per_s"), (F.try_divide("served", "wall_s") * images_each).alias("images_per_s"), "p50", "p95")


def quota_sample(rows: DataFrame, by: str, key_column: str, most: int, seed: str = "42", place: str | None = None) -> DataFrame:
    """At most ``most`` rows a group, chosen by hash of seed and key, so a rerun takes the same; ``place`` names a
    column for their rank."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key_column).cast("string"))), key_column)
    rank = place or "_r"
    out = rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)
    return out if place else out.drop(rank)


def paired_cases(images: DataFrame, degraded: list[str], problems: list[str]) -> DataFrame:
    """From (app, side, variant, file) the cases to evaluate: app, tier, variant, front, back.

    The clean sides make a case together; a degraded or problem image makes one with the clean image of its other
    side, null if there is none. Other variants make none.
    """
    clean = images.where("variant = 'clean'").groupBy("app").agg(F.max(F.when(F.col("side") == "front", F.col("file"))).alias("clean_front"), F.max(F.when(F.col("side") == "back", F.col("file"))).alias("clean_back"))
    own = clean.select("app", F.lit("artwork").alias("tier"), F.lit("clean").alias("variant"), F.col("clean_front").alias("front"), F.col("clean_back").alias("back"))
    tier = F.when(F.col("variant").isin(degraded), "degraded").when(F.col("variant").isin(problems), "problem")
    front = F.col("side") == "front"
    odd = images.withColumn("tier", tier).where("tier is not null").join(clean, "app", "left")
    return own.unionByName(odd.select("app", "tier", "variant", F.when(front, F.col("file")).otherwise(F.col("clean_front")).alias("front"), F.when(front, F.col("clean_back")).otherwise(F.col("file")).alias("back")))


def type_weights(cases: DataFrame) -> DataFrame:
    """Of the warnings located (present, reading, basis): how many headings are heavier, the same, unsure or not
    measured, and why."""
    n = lambda c, *v: F.count_if(F.col(c).isin(*v))
    return cases.where("present").agg(
        n("reading", "heavier").alias("heavier"), n("reading", "same").alias("same"), n("reading", "inconclusive", "boundary_uncertain").alias("unsure"), n("reading", "not_measured").alias("not_measured"),
        n("basis", "too small").alias("too_small"), n("basis", "size differs").alias("size_differs"), n("basis", "no heading line").alias("no_heading"))


def hit_rates(rows: DataFrame) -> DataFrame:
    """From (field, wanted, text, least): a row a field with the share of texts that hold what is wanted, by partial
    ratio of their keys, and the mean score. Each distinct pair is scored once."""
    keyed = rows.select("field", "least", key(F.col("wanted")).alias("w"), key(F.col("text")).alias("t"))
    scores = keyed.select("w", "t").distinct().withColumn("score", F.floor(text_partial_ratio("w", "t")))
    met = keyed.join(scores, ["w", "t"])
    return met.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("least")).alias("hits"), F.avg((F.col("score") >= F.col("least")).cast("int")).alias("rate"), F.avg("score").alias("mean_score"))


#: Each rate's own condition of a row counting, and of its being a hit, over metric rows (see ``rates``).
RATES = {
    "brand_match": ("brand is not null", "brand = 'match'"),
    "class_match": ("class is not null", "class = 'match'"),
    "applicant_match": ("applicant is not null", "applicant = 'match'"),
    "origin_found": ("imported", "origin_found"),
    "warning_located": ("true", "located"),
    "warning_exact": ("located", "assessment = 'exact'"),
    "alcohol_read": ("true", "alcohol is not null"),
    "contents_read": ("true", "contents is not null"),
}


def rates(metrics: DataFrame, by: str = "beverage_type") -> DataFrame:
    """Rates of real records for each type and over all (``of_all``), each over the rows that it is about: only
    imports can name their origin, only a located warning can be exact. Null without any such row."""
    of = {k: (F.expr(due), F.expr(f"({due}) and ({hit})")) for k, (due, hit) in RATES.items()}
    counts = [c for k, (due, hit) in of.items() for c in (F.count_if(due).alias(f"{k}_n"), F.count_if(hit).alias(f"{k}_hits"))]
    out = metrics.groupingSets([[F.col(by)], []], by).agg(F.grouping(by).cast("boolean").alias("of_all"), F.count("*").alias("records"), *counts)
    return out.select(by, "of_all", "records", *[F.col(f"{k}_n") for k in of], *[F.try_divide(f"{k}_hits", f"{k}_n").alias(k) for k in of])
