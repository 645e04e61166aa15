"""Progressive results: lines that land as files are held by item, compared when they are due, and compared anew when
more come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.compare import compare


def landed(spark: SparkSession, path: str, schema: StructType, files_each: int = 8) -> DataFrame:
    """A stream over Parquet files as they land; ``files_each`` a batch holds the load."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def once_each(files: DataFrame, keys: tuple[str, ...] = ("path", "size", "modified"), within: str = "7 days") -> DataFrame:
    """Each version of a file once: a file changed under the same name is read again.

    A stream remembers a file for ``within`` of its arrival, so its state is bounded; arrival never runs late, so no
    file is lost, and one that comes again after that is read again.
    """
    if not files.isStreaming:
        return files.dropDuplicates(list(keys))
    return files.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", within).dropDuplicatesWithinWatermark(list(keys)).drop("_seen")


def _held(wait_ms: int, forget_ms: int):
    """One item's step: takes new lines in, and gives all lines so far when a verdict is due."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, revision, waiting = state.get if state.exists else ("[]", 0, False)
        lines, images = json.loads(text), None
        if state.hasTimedOut:
            if not waiting:
                state.remove()
                return
            complete = False
        else:
            known = {line for _, line in lines}
            before = len(known)
            for frame in frames:
                for image, n, line in zip(frame["image_index"].tolist(), frame["n_images"].tolist(), frame["line"].tolist(), strict=True):
                    images = n if n == n and n is not None else images
                    if line not in known:
                        known.add(line)
                        lines.append((image, line))
            if len(known) == before:
                state.setTimeoutTimestamp(state.getCurrentProcessingTimeMs() + (wait_ms if waiting else forget_ms))
                return
            complete = images is None or len({image for image, _ in lines}) >= images
        due = complete or state.hasTimedOut or revision > 0
        state.update((json.dumps(lines), revision + due, not due))
        state.setTimeoutTimestamp(state.getCurrentProcessingTimeMs() + (forget_ms if due else wait_ms))
        if due:
            yield pd.DataFrame({"item_id": key[0], "revision": revision + 1, "complete": complete, "line": [line for _, line in lines]})

    return step


def gathered(lines: DataFrame, apps: DataFrame, wait: float = 600.0, forget: float = 86_400.0, skew: str = "10 seconds") -> DataFrame:
    """A stream of items as they become due: their lines so far, with ``revision`` (from 1) and ``complete``.

    An item is due when lines of all its images are there (apps may have ``n_images``; without it, at once), or ``wait``
    seconds after its last lines came; and again with every line that comes later, as a further revision of all lines. A
    line that lands twice counts once. What is held of an item goes ``forget`` seconds after it was last due: lines that come
    still later begin a new item. State is one item's lines, kept by the checkpoint over restarts. Time is that of arrival,
    less ``skew`` by which drivers' clocks may differ over a restart, and goes on when lines of any item come.
    """
    columns = lines.columns
    expected = apps.select("item_id", F.col("n_images").cast("double") if "n_images" in apps.columns else F.lit(None).cast("double").alias("n_images"))
    packed = lines.withColumn("_at", F.current_timestamp()).withWatermark("_at", skew).join(expected, "item_id", "left").select("_at", "item_id", F.col("image_index").cast("long").alias("image_index"), "n_images", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))
    kind = lines.schema["item_id"].dataType.simpleString()
    due = packed.groupBy("item_id").applyInPandasWithState(_held(int(wait * 1000), int(forget * 1000)), f"item_id {kind}, revision int, complete boolean, line string", "lines string, revision int, waiting boolean", "append", "EventTimeTimeout")
    own = F.from_json("line", lines.schema)
    return due.select("revision", "complete", *[own[c].alias(c) for c in columns])


def stream_verdicts(lines: DataFrame, apps: DataFrame, out: str, checkpoint: str, wait: float = 600.0, forget: float = 86_400.0, skew: str = "10 seconds") -> StreamingQuery:
    """Writes a verdict of each item that is due (see ``gathered``), on all its lines so far: batch, item_id, verdict,
    revision, complete. Lines of an item may land in any number of batches; a later revision takes an earlier one's place
    (``latest_verdicts``). A batch that is run again overwrites its own folders, so results are exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        # written first: the comparison reads the lines many times, and a stateful plan may run once only
        at = f"{out}/lines/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        read = batch.sparkSession.read.schema(batch.schema).parquet(at)
        if read.isEmpty():  # a batch in which only time went on
            return
        due = read.groupBy("item_id").agg(F.max("revision").alias("revision"), F.bool_or("complete").alias("complete"))
        items = apps.join(due, "item_id", "left_semi")
        found = compare(items, read.drop("revision", "complete"))
        found.verdicts.join(due, "item_id").write.mode("overwrite").parquet(f"{out}/verdicts/batch={number}")
        found.discard()

    # batches without lines are for times that are up; where the number of images is unknown, nothing waits for one
    conf, name = lines.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str("n_images" in apps.columns).lower())
    try:
        return gathered(lines, apps, wait, forget, skew).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def latest_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """The last verdict of each item that ``stream_verdicts`` wrote, with its batch and revision."""
    every = spark.read.parquet(f"{out}/verdicts")
    rest = [c for c in every.columns if c != "item_id"]
    return every.groupBy("item_id").agg(F.max_by(F.struct(*rest), F.struct("batch", "revision")).alias("v")).select("item_id", "v.*")
