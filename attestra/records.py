"""Queries of records, repeated readings and evaluation cases over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate as E
from .operators import intake, pairing, reads
from .queries import _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'not an application in JSON' WHEN 1 THEN 'brand_name: required' WHEN 2 THEN 'beverage_type: not one of spirits, wine, malt' WHEN 3 THEN 'class_type: required;brand_name: longer than 200' ELSE '' END AS errors,
CASE WHEN p_partkey % 6 >= 4 THEN trim(p_name) END AS brand_name, CASE WHEN p_partkey % 6 >= 4 THEN p_partkey % 6 = 4 END AS imported FROM part""")
def json_applications(spark, sf_dir):
    kind = F.col("p_partkey") % 6
    brand = F.when(kind == 1, F.lit("  ")).when(kind == 3, F.repeat(F.lit("x"), 201)).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    fields = F.struct(F.when(kind == 2, "gin").otherwise("wine").alias("beverage_type"), brand.alias("brand_name"), F.when(kind != 3, F.col("p_type")).alias("class_type"), F.when(kind == 4, F.lit(True)).alias("imported"), F.lit("x").alias("other"))
    text = F.when(kind == 0, F.substring(F.to_json(fields), 1, 30)).otherwise(F.to_json(fields))
    found = intake.json_applications(_t(spark, sf_dir, "part").select("p_partkey", text.alias("json")))
    return found.select("p_partkey", F.array_join("errors", ";").alias("errors"), "application.brand_name", "application.imported")


_RECORDS = """SELECT c_custkey AS ttbid, CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'TABLE RED WINE' WHEN 2 THEN 'STOUT' WHEN 3 THEN NULL ELSE 'STRAIGHT WHISKY' END AS class_desc, c_custkey % 4 AS n_images, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE '01/02/2024' END AS date_issued FROM customer"""


@query(f"""WITH r AS ({_RECORDS}), f AS (SELECT ttbid, CASE class_desc WHEN 'TABLE RED WINE' THEN 'wine' WHEN 'STOUT' THEN 'malt' ELSE 'spirits' END AS beverage_type FROM r
WHERE class_desc <> '' AND n_images > 0 AND date_issued <> '' AND ttbid % 7 <> 0),
h AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'wine' ELSE 'malt' END AS beverage_type, count(*) AS have FROM customer WHERE c_custkey % 7 = 0 GROUP BY 1),
p AS (SELECT f.*, row_number() OVER (PARTITION BY f.beverage_type ORDER BY md5('42:' || CAST(ttbid AS VARCHAR)), ttbid) AS place FROM f)
SELECT p.ttbid, p.beverage_type FROM p LEFT JOIN h USING (beverage_type) WHERE place <= 120 - coalesce(have, 0)""")
def new_records(spark, sf_dir):
    customer = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kind = F.when(k % 9 == 0, "").when(k % 9 == 1, "TABLE RED WINE").when(k % 9 == 2, "STOUT").when(k % 9 != 3, "STRAIGHT WHISKY")
    records = customer.select(k.alias("ttbid"), kind.alias("class_desc"), F.array_repeat(F.lit("a.png"), (k % 4).cast("int")).alias("images"), F.when(k % 10 == 0, "").otherwise("01/02/2024").alias("date_issued"))
    held = customer.where(k % 7 == 0).select(k.alias("ttbid"), F.when(k % 2 == 0, "wine").otherwise("malt").alias("beverage_type"))
    return intake.new_records(records, held, 120).select("ttbid", "beverage_type")


@query("""SELECT c_custkey AS application_id, c_mktsegment AS beverage_type, c_name AS brand_name, 'WINE' AS class_type, '' AS alcohol_content, '' AS net_contents, c_name || ', Main St, Salem' AS bottler,
CASE WHEN c_nationkey % 2 = 0 THEN 'France' ELSE 'USA' END AS country_of_origin, CASE WHEN c_nationkey % 2 = 0 THEN 'yes' ELSE 'no' END AS imported, CASE c_custkey % 3 WHEN 1 THEN 'a.png' ELSE 'a.png;b.png' END AS images
FROM customer WHERE c_custkey % 3 <> 0""")
def batch_sheet(spark, sf_dir):
    k = F.col("c_custkey") % 3
    images = F.when(k == 0, F.array(F.lit("  "))).when(k == 1, F.array(F.lit(" a.png "), F.lit(""))).otherwise(F.array(F.lit("a.png"), F.lit("b.png")))
    records = _t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ttbid"), F.col("c_mktsegment").alias("beverage_type"), F.col("c_name").alias("brand"), F.lit("WINE").alias("class_desc"), F.concat("c_name", F.lit(" |  | Main St | Salem")).alias("applicant"),
        F.lit("France").alias("origin_desc"), F.when(F.col("c_nationkey") % 2 == 0, "no").otherwise("yes").alias("domestic"), images.alias("images"))
    return intake.batch_sheet(records)


@query("""SELECT l_orderkey AS item_id, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS INT) AS image_index, s_suppkey AS file, s_name AS text
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey""")
def lines_of_items(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("files"))
    lines = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.lit(1).alias("line_seq"), F.col("s_name").alias("text"))
    return intake.lines_of_items(items, lines).select("item_id", "image_index", "file", "text")


@query("""WITH s AS (SELECT l_orderkey AS image, coalesce(sum(c) FILTER (d = 0 AND c >= 0.5), 0) AS s0, coalesce(sum(c) FILTER (d = 90 AND c >= 0.5), 0) AS s90, coalesce(sum(c) FILTER (d = 270 AND c >= 0.5), 0) AS s270,
coalesce(avg(c) FILTER (d = 0), 0) < 0.8 OR count(*) FILTER (d = 0) < 3 AS poor FROM (SELECT l_orderkey, l_quantity / 64 AS c, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 90 ELSE 270 END AS d FROM lineitem) GROUP BY 1),
t AS (SELECT *, CASE WHEN poor AND s90 > s0 * 1.15 THEN 90 ELSE 0 END AS a, CASE WHEN poor AND s90 > s0 * 1.15 THEN s90 ELSE s0 END AS b FROM s)
SELECT image, CAST(CASE WHEN poor AND s270 > b * 1.15 THEN 270 ELSE a END AS INT) AS chosen, CAST(CASE WHEN poor AND s270 > b * 1.15 THEN s270 ELSE b END AS DOUBLE) AS score FROM t""")
def best_read(spark, sf_dir):
    degrees = F.when(F.col("l_linenumber") % 3 == 0, 0).when(F.col("l_linenumber") % 3 == 1, 90).otherwise(270)
    return reads.best_read(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), degrees.alias("degrees"), (F.col("l_quantity") / 64).alias("confidence")))


@query("""WITH o AS (SELECT l_orderkey AS item_id, l_suppkey, l_quantity AS x FROM lineitem WHERE l_linenumber > 1),
n AS (SELECT l_orderkey AS item_id, l_quantity AS x FROM lineitem WHERE l_linenumber = 1)
SELECT item_id, CAST(x AS DOUBLE) AS x, 'old' AS text FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.item_id = o.item_id AND 10 - abs(n.x - o.x) > 5)
UNION ALL SELECT item_id, CAST(x AS DOUBLE), 'new' FROM n""")
def adopted_lines(spark, sf_dir):
    # boxes ten wide and ten high in one row, so more than half is shared where left edges are less than five apart
    point = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    x = F.col("l_quantity")
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.lit(0).alias("image_index"), F.monotonically_increasing_id().alias("line_seq"), F.array(point(x, 0), point(x + 10, 0), point(x + 10, 10), point(x, 10)).alias("box"), F.when(F.col("l_linenumber") == 1, "new").otherwise("old").alias("text"))
    out = reads.adopted(rows.where("text = 'old'"), rows.where("text = 'new'"))
    return out.select("item_id", F.col("box")[0]["x"].alias("x"), "text")


@query("""SELECT o_custkey AS item_id, CAST(max(CAST(o_totalprice AS BIGINT) % 500) AS BIGINT) AS queue_ms, string_agg(CAST(CAST(o_totalprice AS BIGINT) % 1000 AS VARCHAR), ',' ORDER BY o_orderkey, CAST(o_totalprice AS BIGINT) % 1000) AS ocr_ms FROM orders GROUP BY 1""")
def request_timing(spark, sf_dir):
    # DuckDB's cast rounds to the nearest
    price = F.rint("o_totalprice").cast("long")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("image_index"), (price % 500).alias("queue_ms"), (price % 1000).alias("ocr_ms"))
    return reads.timing(rows).select("item_id", "queue_ms", F.array_join("ocr_ms", ",").alias("ocr_ms"))


@query("""WITH i AS (SELECT p_partkey // 5 AS app, CASE WHEN p_partkey % 2 = 0 THEN 'front' ELSE 'back' END AS side, CASE p_partkey % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'clean' WHEN 2 THEN 'blur' WHEN 3 THEN 'missing' ELSE 'other' END AS variant, p_partkey AS file FROM part),
c AS (SELECT app, max(file) FILTER (side = 'front') AS f, max(file) FILTER (side = 'back') AS b FROM i WHERE variant = 'clean' GROUP BY 1)
SELECT app, 'artwork' AS tier, 'clean' AS variant, f AS front, b AS back FROM c
UNION ALL SELECT i.app, CASE variant WHEN 'blur' THEN 'degraded' ELSE 'problem' END, variant, CASE WHEN side = 'front' THEN file ELSE f END, CASE WHEN side = 'front' THEN b ELSE file END FROM i LEFT JOIN c USING (app) WHERE variant IN ('blur', 'missing')""")
def paired_cases(spark, sf_dir):
    k = F.col("p_partkey")
    variant = F.when(k % 5 < 2, "clean").when(k % 5 == 2, "blur").when(k % 5 == 3, "missing").otherwise("other")
    images = _t(spark, sf_dir, "part").select(F.floor(k / 5).alias("app"), F.when(k % 2 == 0, "front").otherwise("back").alias("side"), variant.alias("variant"), k.alias("file"))
    return E.paired_cases(images, ["blur"], ["missing"])


_READINGS, _BASES = ["heavier", "same", "inconclusive", "boundary_uncertain", "not_measured"], ["the other lines", "too small", "size differs", "no heading line"]


@query("""SELECT count(*) FILTER (k % 5 = 0) AS heavier, count(*) FILTER (k % 5 = 1) AS same, count(*) FILTER (k % 5 IN (2, 3)) AS unsure, count(*) FILTER (k % 5 = 4) AS not_measured,
count(*) FILTER (k % 4 = 1) AS too_small, count(*) FILTER (k % 4 = 2) AS size_differs, count(*) FILTER (k % 4 = 3) AS no_heading FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 3 <> 0""")
def type_weights(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    return E.type_weights(_t(spark, sf_dir, "orders").select((k % 3 != 0).alias("present"), pick(_READINGS).alias("reading"), pick(_BASES).alias("basis")))


@query("""SELECT p_brand AS field, count(*) AS n, count(*) FILTER (p_partkey % 3 <> 0) AS hits, CAST(count(*) FILTER (p_partkey % 3 <> 0) AS DOUBLE) / count(*) AS rate, CAST(100 * count(*) FILTER (p_partkey % 3 <> 0) AS DOUBLE) / count(*) AS mean_score FROM part GROUP BY 1""")
def hit_rates(spark, sf_dir):
    # a text that has no letter of what is wanted, or has it whole
    text = F.when(F.col("p_partkey") % 3 == 0, "0123 456").otherwise(F.concat(F.lit("Name: "), F.upper("p_type"), F.lit("!")))
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("field"), F.col("p_type").alias("wanted"), text.alias("text"), F.lit(88).alias("least"))
    return E.hit_rates(rows)


@query("""WITH m AS (SELECT CASE WHEN c_custkey % 11 > 0 THEN c_mktsegment END AS beverage_type, c_custkey AS k FROM customer)
SELECT beverage_type, grouping(beverage_type) = 1 AS of_all, count(*) AS records, count(*) FILTER (k % 2 = 0) AS brand_match_n, count(*) AS class_match_n, count(*) AS applicant_match_n, count(*) FILTER (k % 3 = 0) AS origin_found_n, count(*) AS warning_located_n, count(*) FILTER (k % 4 > 0) AS warning_exact_n, count(*) AS alcohol_read_n, count(*) AS contents_read_n,
CASE WHEN count(*) FILTER (k % 2 = 0) > 0 THEN CAST(count(*) FILTER (k % 2 = 0 AND k % 10 < 5) AS DOUBLE) / count(*) FILTER (k % 2 = 0) END AS brand_match, CAST(count(*) FILTER (k % 5 = 0) AS DOUBLE) / count(*) AS class_match, CAST(count(*) FILTER (k % 5 = 1) AS DOUBLE) / count(*) AS applicant_match,
CASE WHEN count(*) FILTER (k % 3 = 0) > 0 THEN CAST(count(*) FILTER (k % 3 = 0 AND k % 7 > 0) AS DOUBLE) / count(*) FILTER (k % 3 = 0) END AS origin_found, CAST(count(*) FILTER (k % 4 > 0) AS DOUBLE) / count(*) AS warning_located,
CASE WHEN count(*) FILTER (k % 4 > 0) > 0 THEN CAST(count(*) FILTER (k % 4 > 0 AND k % 6 > 1) AS DOUBLE) / count(*) FILTER (k % 4 > 0) END AS warning_exact, CAST(count(*) FILTER (k % 8 > 0) AS DOUBLE) / count(*) AS alcohol_read, 1.0::DOUBLE AS contents_read FROM m GROUP BY GROUPING SETS ((beverage_type), ())""")
def real_record_rates(spark, sf_dir):
    k = F.col("c_custkey")
    match = lambda yes: F.when(yes, "match").otherwise("mismatch")
    metrics = _t(spark, sf_dir, "customer").select(
        F.when(k % 11 > 0, F.col("c_mktsegment")).alias("beverage_type"), F.when(k % 2 == 0, match(k % 10 < 5)).alias("brand"), match(k % 5 == 0).alias("class"), match(k % 5 == 1).alias("applicant"), (k % 3 == 0).alias("imported"), (k % 7 > 0).alias("origin_found"),
        (k % 4 > 0).alias("located"), F.when(k % 6 > 1, "exact").otherwise("noise").alias("assessment"), F.when(k % 8 > 0, 40.0).alias("alcohol"), F.lit(750.0).alias("contents"))
    return E.rates(metrics)


#: Every part lists a file of its own folder and the bare name that all these files have; one part in ten has no folder.
_SHARED = """WITH r AS (SELECT p_partkey AS row_number, p_partkey % 10 > 0 AS own, count(*) FILTER (p_partkey % 10 > 0) OVER (ORDER BY p_partkey DESC) AS open FROM part),
e AS (SELECT row_number, own, open, unnest([0, 1]) AS ord FROM r),
f AS (SELECT *, CASE WHEN own AND (ord = 0 OR open = 1) THEN row_number WHEN NOT own AND open = 1 THEN (SELECT min(b.row_number) FROM r b WHERE b.own AND b.row_number > (SELECT max(row_number) FROM r c WHERE c.own AND c.open > 1)) END AS file FROM e)"""


def _shared_names(spark: SparkSession, sf_dir: str) -> pairing.Pairing:
    k = F.col("p_partkey")
    own = F.concat(k.cast("string"), F.lit("/Front.png"))
    part = _t(spark, sf_dir, "part")
    rows = part.select(k.alias("row_number"), F.lit(None).cast("string").alias("application_id"), F.array(own, F.lit("front.PNG")).alias("images"))
    return pairing.pair(rows, part.where(k % 10 > 0).select(F.concat(F.lit("batch/"), own).alias("path")))


@query(_SHARED + """ SELECT row_number, CAST(ord AS INT) AS position, 'batch/' || file || '/Front.png' AS path FROM f WHERE file IS NOT NULL""")
def shared_names(spark, sf_dir):
    return _shared_names(spark, sf_dir).pairs


@query(_SHARED + """ SELECT row_number, CAST(ord AS INT) AS ord, CASE ord WHEN 0 THEN row_number || '/Front.png' ELSE 'front.PNG' END AS listed, CASE WHEN open = 0 THEN 'not found' ELSE 'ambiguous' END AS why FROM f WHERE file IS NULL""")
def listed_and_not_taken(spark, sf_dir):
    return _shared_names(spark, sf_dir).missing
