"""Records on their way in: JSON applications, registry records, the sheet made from them, and lines read earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.csv_intake import LIMITS
from ..sources.registry import registry_class
from .evaluate import quota_sample

APPLICATION = "application_id string, beverage_type string, brand_name string, class_type string, alcohol_content string, net_contents string, bottler string, country_of_origin string, imported boolean"
BEVERAGES = ("spirits", "wine", "malt")
REQUIRED = ("brand_name", "class_type")


def json_applications(rows: DataFrame, json: str = "json") -> DataFrame:
    """Adds ``application`` (a struct of the nine fields, texts trimmed) and ``errors`` to rows of JSON texts.

    A text that is no JSON object, or holds another type where a field's is due, is one error; otherwise every rule
    that is broken is named. ``application`` is null where there are errors, also for a null text.
    """
    read = F.from_json(F.col(json), f"{APPLICATION}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    out = rows.withColumn("_read", read)
    texts = [f.split(" ")[0] for f in APPLICATION.split(", ") if f.endswith(" string")]
    field = {f: F.trim(F.col(f"_read.{f}")) for f in texts}
    broken = F.col(json).isNull() | ~F.trim(json).startswith("{") | F.col("_read").isNull() | F.col("_read._broken").isNotNull()
    missing = [F.when(F.coalesce(field[f], F.lit("")) == "", F.lit(f"{f}: required")) for f in REQUIRED]
    kind = F.when(~F.coalesce(field["beverage_type"].isin(*BEVERAGES), F.lit(False)), F.lit("beverage_type: not one of spirits, wine, malt"))
    late = [F.when(F.length(field[f]) > n, F.lit(f"{f}: longer than {n}")) for f, n in LIMITS.items()]
    errors = F.when(broken, F.array(F.lit("not an application in JSON"))).otherwise(F.array_compact(F.array(kind, *missing, *late)))
    whole = F.struct(*[field[f].alias(f) for f in texts], F.coalesce("_read.imported", F.lit(False)).alias("imported"))
    return out.withColumn("errors", errors).withColumn("application", F.when(F.size("errors") == 0, whole)).drop("_read")


def new_records(records: DataFrame, held: DataFrame, per_type: int, seed: str = "42") -> DataFrame:
    """Registry records (ttbid, class_desc, images, date_issued, ...) worth taking, with their ``beverage_type``.

    They have a class, images and a date of issue, and are not held yet; of each type so many are taken as the held
    ones (ttbid, beverage_type) leave of ``per_type``, in an order by hash.
    """
    usable = (F.trim("class_desc") != "") & (F.size("images") > 0) & (F.trim("date_issued") != "")
    fresh = records.where(usable).join(held.select("ttbid").distinct(), "ttbid", "left_anti").withColumn("beverage_type", registry_class(F.col("class_desc")))
    have = held.groupBy("beverage_type").agg(F.count_distinct("ttbid").alias("_have"))
    open_ = fresh.join(F.broadcast(have), "beverage_type", "left").where(F.coalesce("_have", F.lit(0)) < per_type)
    first = quota_sample(open_.withColumn("_place", F.lit(0)), "beverage_type", "ttbid", per_type, seed, place="_place")
    return first.where(F.col("_place") <= per_type - F.coalesce("_have", F.lit(0))).drop("_have", "_place")


def batch_sheet(records: DataFrame) -> DataFrame:
    """The batch spreadsheet's row for each registry record that has images. Alcohol and net contents are left blank;
    the applicant's parts are joined by commas; what is not imported is from the USA."""
    names = F.filter(F.transform("images", lambda x: F.trim(x)), lambda x: x != "")
    imported = F.col("domestic") == "no"
    parts = F.filter(F.transform(F.split("applicant", r" \| "), lambda x: F.trim(x)), lambda x: x != "")
    return records.withColumn("_names", names).where("size(_names) > 0").select(
        F.col("ttbid").alias("application_id"), "beverage_type", F.col("brand").alias("brand_name"), F.col("class_desc").alias("class_type"), F.lit("").alias("alcohol_content"), F.lit("").alias("net_contents"),
        F.array_join(parts, ", ").alias("bottler"), F.when(imported, F.col("origin_desc")).otherwise("USA").alias("country_of_origin"), F.when(imported, "yes").otherwise("no").alias("imported"), F.array_join("_names", ";").alias("images"))


def lines_of_items(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines read once a file (file, line_seq, ...), for each item (item_id, files) that has the file; image_index is
    the file's place in the item. Files that were not read give no lines."""
    at = items.select("item_id", F.posexplode("files").alias("image_index", "file"))
    return at.join(lines.drop("image_index", "item_id"), "file")
