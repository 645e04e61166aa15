"""Applications and label lines made from the driver's tables, so that every operator runs on whole tables.

Each part is an application; its label is a column of lines that repeat the application with planted differences by
part key: another percentage, another volume, a title-case warning, a missing line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.warning import STATEMENT

KIND = "CASE p_partkey % 3 WHEN 0 THEN 'spirits' WHEN 1 THEN 'wine' ELSE 'malt' END"
ABV = "CAST(5 + p_size AS STRING)"
ML = "CASE p_partkey % 4 WHEN 0 THEN '750 mL' WHEN 1 THEN '1,75 L' WHEN 2 THEN '12 FL. OZ.' ELSE '500 ml' END"


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.selectExpr("p_partkey AS item_id", f"{KIND} AS beverage_type", "p_name AS brand_name", "p_type AS class_type", f"concat({ABV}, '% Alc./Vol. (', CAST(2 * (5 + p_size) AS STRING), ' Proof)') AS alcohol_content", f"{ML} AS net_contents",
                           "concat('Bottled by ', p_brand, ' Company, 12 Main Street, Salem, OR, 97301') AS bottler", "CASE WHEN p_partkey % 5 = 0 THEN 'France' END AS country_of_origin", "p_partkey % 5 = 0 AS imported")


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    half = STATEMENT.index(" (2)")
    texts = ["upper(p_name)", "p_type", f"concat(CAST(5 + p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS STRING), '% ALC/VOL')", f"CASE WHEN p_partkey % 11 = 0 THEN '700 mL' ELSE {ML} END", "concat('BOTTLED BY ', upper(p_brand), ' CO.')", "'SALEM, OR 97301'",
             "CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Product of France' ELSE 'Made in Italy' END END", f"CASE p_partkey % 13 WHEN 0 THEN NULL WHEN 1 THEN initcap('{STATEMENT[:half]}') ELSE '{STATEMENT[:half]}' END", f"CASE p_partkey % 13 WHEN 0 THEN NULL ELSE '{STATEMENT[half + 1:]}' END"]
    each = part.select(F.col("p_partkey").alias("item_id"), F.posexplode(F.array(*[F.expr(t) for t in texts])).alias("line_seq", "text")).where("text is not null")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    top, right = 100 + 52 * F.col("line_seq"), 100 + F.greatest(F.lit(20), 22 * F.length("text"))
    box = F.array(point(F.lit(100), top), point(right, top), point(right, top + 40), point(F.lit(100), top + 40))
    return each.select("item_id", F.lit(0).alias("image_index"), "line_seq", "text", F.lit(0.98).alias("confidence"), box.alias("box"))
