"""Batch work: pairing files with rows, counters, filters, order, pages, and the row of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename
from .pairing import pair

SEVERITY = {"issues_found": 0, "unreadable": 1, "needs_review": 2, "ready_for_approval": 3}
MOST_BYTES = 10 * 1024 * 1024


def accepted_files(files: DataFrame) -> DataFrame:
    """Images of (path, size, type) with something in them and at most 10 MB, each path once, whatever its case."""
    image = F.when(F.coalesce("type", F.lit("")) != "", F.col("type").rlike(r"(?i)^image/(png|jpe?g|gif|webp|tiff?|bmp)")).otherwise(F.col("path").rlike(r"(?i)\.(png|jpe?g|gif|webp|tiff?|bmp)$"))
    return files.where(image & (F.col("size") > 0) & (F.col("size") <= MOST_BYTES)).groupBy(F.lower("path").alias("_key")).agg(F.min(F.struct("path", "size")).alias("f")).select("f.path", "f.size")


def duplicate_names(files: DataFrame) -> DataFrame:
    return files.groupBy(basename(F.col("path")).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def item_keys(rows: DataFrame) -> DataFrame:
    """Adds ``item_key``: the reference, else row-<n>; from the second row with a reference on, with its row."""
    base = F.coalesce("application_id", F.concat(F.lit("row-"), F.col("row_number").cast("string")))
    again = F.row_number().over(Window.partitionBy("base").orderBy("row_number")) > 1
    return rows.withColumn("base", base).withColumn("item_key", F.when(again, F.concat("base", F.lit(" (row "), F.col("row_number").cast("string"), F.lit(")"))).otherwise(F.col("base"))).drop("base")


def pair_files(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_number, position, path) of the files each row takes, and the paths that no row takes; see ``pairing``."""
    found = pair(rows, files)
    return found.pairs, found.unpaired


def counters(items: DataFrame) -> DataFrame:
    """One row of counts over (status, verdict, decision), with progress in percent."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    v, s = F.col("verdict"), F.col("status")
    out = items.agg(F.count("*").alias("total"), n(s == "done").alias("done"), n(v == "ready_for_approval").alias("ready"), n(v == "needs_review").alias("review"), n(v == "issues_found").alias("issues"), n(v == "unreadable").alias("unreadable"), n(s == "error").alias("errors"), n(s == "no-images").alias("no_images"), n(F.col("decision").isNotNull()).alias("decided"))
    workable = F.col("total") - F.col("no_images")
    return out.withColumn("percent", F.when(workable > 0, F.round(100 * (F.col("done") + F.col("errors")) / workable)).otherwise(0).cast("long"))


def eta_ms(elapsed: Column, finished: Column, workable: Column) -> Column:
    return F.when(finished > 0, elapsed / finished * (workable - finished))


def shown(items: DataFrame, what: str = "all") -> DataFrame:
    v, s = F.col("verdict"), F.col("status")
    when = {"attention": s.isin("error", "no-images") | v.isin("issues_found", "needs_review", "unreadable"), "ready": v == "ready_for_approval", "undecided": (s == "done") & F.col("decision").isNull(), "all": F.lit(True)}[what]
    return items.where(F.coalesce(when, F.lit(False)))


def severity() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p]), "verdict"), F.lit(4))


def in_order(items: DataFrame) -> DataFrame:
    return items.orderBy(severity(), F.coalesce("row_number", F.lit(0)), "item_key")


def page(items: DataFrame, number: int, size: int = 50) -> DataFrame:
    """A page of the ordered items (from 0); past the last page, the last."""
    last = max(0, (items.count() - 1) // size)
    return in_order(items).offset(min(max(number, 0), last) * size).limit(size)


def latest_decisions(log: DataFrame, version: Column | int) -> DataFrame:
    """Of a log (item_key, decision, note, at, input_version), the latest a key made on this version of the inputs."""
    return log.where(F.col("input_version") == version).groupBy("item_key").agg(F.max_by(F.struct("decision", "note"), "at").alias("d")).select("item_key", "d.decision", "d.note").where("decision is not null")


def look_at(checks: DataFrame, warning: DataFrame) -> DataFrame:
    """(item_id, what_to_look_at): every check that is no plain match, then the warning."""
    order = F.array_position(F.array(*[F.lit(c) for c in ("brand_name", "class_type", "alcohol_content", "net_contents", "bottler", "country_of_origin", "standard_of_fill")]), F.col("check_id"))
    open_ = checks.where(~F.col("status").isin("match", "info", "not_checked"))
    per = open_.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat("check_id", F.lit(": "), F.replace("status", F.lit("_"), F.lit(" "))).alias("t")))), lambda x: x["t"]).alias("texts"))
    w = F.col("warning")
    text = F.when(w["assessment"] == "not_required", None).when(~w["present"], "warning: missing").when(~w["exact"], "warning: wording not exact").when(w["caps"] != "match", "warning: not all capitals")
    bold = F.when(w["present"] & (w["bold"] == "needs_review"), F.when(w["type_weight_reading"] == "same", "warning: may not be bold").otherwise("warning: confirm bold type"))
    return warning.join(per.hint("merge"), "item_id", "left").select("item_id", F.concat_ws("; ", "texts", text, bold).alias("what_to_look_at"))

