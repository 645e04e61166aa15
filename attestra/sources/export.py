"""Results as a spreadsheet: every cell quoted, formulas disarmed, CRLF lines, a byte order mark; and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "application_id brand_name class_type verdict what_to_look_at summary brand_status class_status alcohol_status net_contents_status bottler_status origin_status warning_present warning_exact warning_anchor_caps decision note images elapsed_ms exported_at".split()


def cell(c: Column) -> Column:
    """Quoted text; what a spreadsheet would run as a formula, also behind blanks, gets an apostrophe."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(s.rlike(r"^[\s\x00-\x1f]*[=+\-@]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame) -> DataFrame:
    """One string column ``line``."""
    return df.select(F.concat_ws(",", *[cell(F.col(c)) for c in df.columns]).alias("line"))


def write_export(df: DataFrame, path: str, stamp: Column | None = None) -> None:
    """One file in a folder; a person reads it, so it is one partition. The first line is the header."""
    out = df.withColumn("exported_at", F.date_format(stamp if stamp is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    lines = csv_lines(out).withColumn("o", F.lit(1))
    head = df.sparkSession.createDataFrame([("﻿" + ",".join(f'"{c}"' for c in out.columns), 0)], "line string, o int")
    head.unionByName(lines).repartition(1).sortWithinPartitions("o").select("line").write.option("lineSep", "\r\n").mode("overwrite").text(path)


def read_export(spark: SparkSession, path: str, columns: list[str] = COLUMNS) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"{c} string" for c in columns)).csv(path)
    booleans = {c: F.lower(c) == "true" for c in ("warning_present", "warning_exact") if c in columns}
    return raw.withColumns({c: F.when(F.col(c) != "", v) for c, v in booleans.items()})
