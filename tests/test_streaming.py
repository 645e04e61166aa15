"""Streams over landed files: each version of a file once, verdicts as lines come, nothing twice after a restart."""

import time

from pyspark.sql import functions as F

from attestra.plans.compare import Comparison
from attestra.sources import fixtures
from attestra.streaming import progress

SF = "/root/testdata/sf0.001"


def test_each_version_of_a_file_once(spark, tmp_path):
    kind = "path string, size long, modified timestamp"
    land = lambda rows: spark.createDataFrame(rows, "path string, size long, at string").selectExpr("path", "size", "CAST(at AS timestamp) AS modified").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        files = progress.once_each(progress.landed(spark, f"{tmp_path}/in", spark.createDataFrame([], kind).schema))
        assert files.columns == ["path", "size", "modified"]
        files.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"], r["size"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    land([("a", 1, "2024-01-02"), ("a", 1, "2024-01-02"), ("b", 2, "2024-01-02")])
    assert run() == [("a", 1), ("b", 2)]
    # the same again, a changed one, and one far older than all before, which is not late
    land([("a", 1, "2024-01-02"), ("b", 3, "2024-01-03"), ("c", 4, "1999-01-01")])
    assert run() == [("a", 1), ("b", 2), ("b", 3), ("c", 4)]
    assert run() == [("a", 1), ("b", 2), ("b", 3), ("c", 4)]


def test_verdicts_as_lines_land(spark, tmp_path):
    apps = fixtures.applications(spark, SF).where("item_id between 7 and 13").cache()
    lines = fixtures.label_lines(spark, SF).where("item_id between 7 and 13").cache()

    def run():
        progress.stream_verdicts(progress.landed(spark, f"{tmp_path}/in", lines.schema), apps, f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
        return {r["item_id"]: (r["verdict"], r["batch"]) for r in progress.latest_verdicts(spark, f"{tmp_path}/out").collect()}

    lines.where("item_id < 10").coalesce(1).write.parquet(f"{tmp_path}/in")
    first = run()
    assert sorted(first) == [7, 8, 9] and first[7] == ("issues_found", 0) and first[8] == ("needs_review", 0)
    lines.where("item_id >= 10").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    both = run()
    assert sorted(both) == list(range(7, 14)) and both[13] == ("issues_found", 1) and {k: both[k] for k in first} == first


def test_an_item_in_parts(spark, tmp_path, monkeypatch):
    """Lines of one item in three batches, each read by a new start of the stream; one item whose second image is late
    beyond its time; one that a spreadsheet knows nothing of."""
    apps = fixtures.applications(spark, SF).where("item_id in (8, 9, 10)").withColumn("n_images", F.when(F.col("item_id") == 10, None).otherwise(F.lit(2))).cache()
    lines = fixtures.label_lines(spark, SF).where("item_id in (8, 9, 10)").withColumn("image_index", F.when(F.col("line_seq") < 5, 0).otherwise(1)).cache()
    whole = {r["item_id"]: r["count"] for r in lines.groupBy("item_id").count().collect()}
    # the comparison itself is the other test's: here a verdict is the number of lines it saw
    counted = lambda items, read: Comparison(None, None, read.join(items, "item_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("verdict")))
    monkeypatch.setattr(progress, "compare", counted)

    def run(when, wait=600.0):
        lines.where(when).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        progress.stream_verdicts(progress.landed(spark, f"{tmp_path}/in", lines.schema), apps, f"{tmp_path}/out", f"{tmp_path}/at", wait, skew="0 seconds").awaitTermination(60)
        if not (tmp_path / "out" / "verdicts").exists():
            return {}
        return {r["item_id"]: (r["verdict"], r["revision"], r["complete"]) for r in progress.latest_verdicts(spark, f"{tmp_path}/out").collect()}

    assert run("item_id = 8 and line_seq < 2") == {}  # one image of two: held
    got = run("item_id = 9 and image_index = 0 or item_id = 10 and line_seq < 3", wait=0.5)
    assert sorted(got) == [10] and got[10][1:] == (1, True)  # number of images unknown: due at once
    time.sleep(1)
    got = run("item_id = 8 and line_seq between 2 and 6 or item_id = 10 and line_seq >= 3")
    assert got[8][1:] == (1, True) and got[9][1:] == (1, False)  # second image of 8 began; the time of 9 is up
    assert got[10] == (whole[10], 2, True)  # a revision of all its lines
    got = run("item_id = 8 and line_seq > 5 or item_id = 9 and image_index = 1")  # one line of 8 lands again
    assert {k: v[0] for k, v in got.items()} == whole and got[8][1:] == (2, True) and got[9][1:] == (2, True)
    held = spark.read.parquet(f"{tmp_path}/out/lines").where("item_id = 8 and revision = 2")
    assert held.count() == lines.where("item_id = 8").count()
