"""Queries of the evaluation on real records, over every customer as a record, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate as E
from .operators import real
from .operators.warning import STATEMENT
from .queries import _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


ORIGIN = "CASE c_nationkey % 4 WHEN 0 THEN 'PERU' WHEN 1 THEN 'ITALY' WHEN 2 THEN 'FRANCE' ELSE 'PORTUGAL' END"

# a lost letter leaves 90 of 100 only in names of six letters and more
_METRICS = f"""SELECT c_custkey AS item_id, CASE c_custkey % 3 WHEN 0 THEN 'spirits' WHEN 1 THEN 'wine' ELSE 'malt' END AS beverage_type, c_custkey % 3 <> 0 AS imported,
CASE WHEN c_custkey % 17 > 0 THEN CASE c_custkey % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'needs_review' ELSE 'match' END END AS brand,
CASE WHEN c_custkey % 17 > 0 AND c_custkey % 5 > 0 THEN CASE c_custkey % 5 WHEN 1 THEN substr(c_mktsegment, 1, 3) || substr(c_mktsegment, 5) ELSE c_mktsegment END || ' RESERVE' END AS brand_found,
CASE WHEN c_custkey % 17 > 0 AND c_custkey % 5 > 0 THEN CASE c_custkey % 5 WHEN 1 THEN floor(200.0 * (length(c_mktsegment) + 7) / (2 * length(c_mktsegment) + 15)) ELSE 100 END::DOUBLE END AS brand_score,
'match' AS class, CASE WHEN c_custkey % 4 > 0 THEN CASE WHEN c_custkey % 6 = 0 THEN 'needs_review' ELSE 'match' END END AS applicant,
CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 > 1 OR (c_custkey % 7 = 1 AND length({ORIGIN}) >= 6) END AS origin_found,
c_custkey % 13 > 0 AS located, CASE WHEN c_custkey % 13 > 0 THEN 'exact' ELSE 'absent' END AS assessment, CASE c_custkey % 13 WHEN 0 THEN 'not_found' WHEN 1 THEN 'needs_review' ELSE 'match' END AS caps,
CASE WHEN c_custkey % 8 > 0 THEN (5 + c_custkey % 40)::DOUBLE END AS alcohol, '750' AS contents,
4::BIGINT + (c_custkey % 5 > 0)::BIGINT + (c_custkey % 8 > 0)::BIGINT + (c_custkey % 7 > 0)::BIGINT + 2 * (c_custkey % 13 > 0)::BIGINT AS n_lines FROM customer"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as an approved record; two in three are imports."""
    rows = _t(spark, sf_dir, "customer")
    return rows.selectExpr(
        "c_custkey AS item_id", "CASE c_custkey % 3 WHEN 0 THEN 'spirits' WHEN 1 THEN 'wine' ELSE 'malt' END AS beverage_type", "CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE c_mktsegment || ' Reserve' END AS brand", "'Table ' || c_mktsegment AS class_desc",
        "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Oak Hill Winery LLC |  | 12 Main Street | Salem, OR, 97301' END AS applicant", f"{ORIGIN} AS origin_desc", "CASE WHEN c_custkey % 3 = 0 THEN 'yes' ELSE 'no' END AS domestic")


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read of their labels: names whole, with a letter lost or not at all."""
    rows = _t(spark, sf_dir, "customer")
    half = STATEMENT.index(" (2)")
    texts = ["CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN substr(c_mktsegment, 1, 3) || substr(c_mktsegment, 5) || ' RESERVE' ELSE upper(c_mktsegment) || ' RESERVE' END", "'TABLE ' || c_mktsegment",
             "CASE WHEN c_custkey % 8 > 0 THEN CAST(5 + c_custkey % 40 AS STRING) || '% ALC/VOL' END", "'750 mL'", "CASE WHEN c_custkey % 6 = 0 THEN 'BOTTLED BY QRXZ' ELSE 'BOTTLED BY OAK HILL WINERY' END", "'SALEM, OR 97301'",
             f"CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Vin de ' || substr({ORIGIN}, 1, 1) || substr({ORIGIN}, 3) ELSE 'PRODUCT OF ' || {ORIGIN} END", f"CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 13 = 1 THEN initcap('{STATEMENT[:half]}') ELSE '{STATEMENT[:half]}' END", f"CASE WHEN c_custkey % 13 > 0 THEN '{STATEMENT[half + 1:]}' END"]
    each = rows.select(F.col("c_custkey").alias("item_id"), F.posexplode(F.array(*[F.expr(t) for t in texts])).alias("line_seq", "text")).where("text is not null")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    top, right = 100 + 52 * F.col("line_seq"), 100 + F.greatest(F.lit(20), 22 * F.length("text"))
    box = F.array(point(F.lit(100), top), point(right, top), point(right, top + 40), point(F.lit(100), top + 40))
    return each.select("item_id", F.lit(0).alias("image_index"), "line_seq", "text", F.lit(0.98).alias("confidence"), box.alias("box"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return real.metrics(records(spark, sf_dir), label_lines(spark, sf_dir))


@query(_METRICS)
def real_record_metrics(spark, sf_dir):
    hidden = lambda c: F.when(F.col("brand") != "not_found", F.col(c)).alias(c)
    return _metrics(spark, sf_dir).select("item_id", "beverage_type", "imported", "brand", hidden("brand_found"), hidden("brand_score"), "class", "applicant", "origin_found", "located", "assessment", "caps", "alcohol", "contents", "n_lines")


@query(f"""WITH m AS ({_METRICS}) SELECT beverage_type, grouping(beverage_type) = 1 AS of_all, count(*) AS records, count(brand) AS brand_match_n, count(class) AS class_match_n, count(applicant) AS applicant_match_n, count(*) FILTER (imported) AS origin_found_n,
count(*) AS warning_located_n, count(*) FILTER (located) AS warning_exact_n, count(*) AS alcohol_read_n, count(*) AS contents_read_n,
CAST(count(*) FILTER (brand = 'match') AS DOUBLE) / count(brand) AS brand_match, CAST(count(*) FILTER (class = 'match') AS DOUBLE) / count(class) AS class_match, CAST(count(*) FILTER (applicant = 'match') AS DOUBLE) / count(applicant) AS applicant_match,
CASE WHEN count(*) FILTER (imported) > 0 THEN CAST(count(*) FILTER (imported AND origin_found) AS DOUBLE) / count(*) FILTER (imported) END AS origin_found, CAST(count(*) FILTER (located) AS DOUBLE) / count(*) AS warning_located,
CAST(count(*) FILTER (assessment = 'exact') AS DOUBLE) / count(*) FILTER (located) AS warning_exact, CAST(count(alcohol) AS DOUBLE) / count(*) AS alcohol_read, CAST(count(contents) AS DOUBLE) / count(*) AS contents_read FROM m GROUP BY GROUPING SETS ((beverage_type), ())""")
def real_record_averages(spark, sf_dir):
    return E.rates(_metrics(spark, sf_dir))
