"""Tables written on the way of a long plan: what follows begins with a short plan, and nothing is computed twice.

The driver holds a plan's text, its expressions and its compiled code for as long as it runs, and Spark plans all of it anew
after each stage; so the parts of the comparison run one by one, each by a plan of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which driver and executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a table. ``discard`` removes it; what is not discarded goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote and that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
