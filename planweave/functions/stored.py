"""Tables between the steps of a job: written once to the folder that driver and executors share, then read as often as needed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only on one machine, where the session names none, a temporary one is set."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if not named and not (sc.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="planweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet and read back: what follows knows its size, and reads it instead of working it out again."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
