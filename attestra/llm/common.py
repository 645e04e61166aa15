"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Java class of what separates words of digits, a-z and everything past ASCII (after ``ascii_lower``).
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Java class of the six ASCII blanks; what stands between them are tokens.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Only Spark reads it, so any file system that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be no column's name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast built-in, where both agree."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of the words of digits, letters and non-ASCII characters, ASCII lower-cased; null gives an empty array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def token_count(text: Column) -> Column:
    """How many tokens between ASCII blanks the text has; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")).cast("long")


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; only where there is none and driver and
    executors are one machine, as in tests, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


_cuts = itertools.count(1)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder. Every fourth time the
    shuffle files of what lies behind are released."""
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    if not next(_cuts) % 4:
        release(df.sparkSession)
    return kept


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints, which goes when the driver ends."""
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a table written in the shared folder of the checkpoints.

    Unlike ``cut`` it computes the rows once, packs small files into one task when they are read, and lets the
    optimizer see how large they are. ``discard`` removes it; what is not discarded goes when the driver ends.
    """
    spark = df.sparkSession
    path = temporary_folder(spark, "stored")
    df.write.parquet(path)
    if not next(_cuts) % 4:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that ``stored`` wrote and that nothing reads any more."""
    for t in tables:
        if t is not None:
            sc = t.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(t._stored_at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has shuffle files of finished steps removed now, not when the driver happens to collect its garbage.

    After ``cut`` no plan needs them; between the many steps of an iterative operator they would add up on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Frames made in here lose their shuffle files as soon as an action on them has ended, instead of when the driver
    collects its garbage. For frames that are written or checkpointed once."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)
