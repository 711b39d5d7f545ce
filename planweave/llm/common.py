"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it: space and the codes 9 to 13.
WHITE = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch: texts may be long, and a batch lies in memory several times.
BATCH_ROWS, BATCH_BYTES = 2_000, 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; its session sends texts to Python in small batches, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if not named and not (sc.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="planweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Where paths are noted while a stage of a pipeline is put together.
_noted: list[list[str]] = []


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """The paths that operators make inside, for whoever knows when nothing reads them any more."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _noted:
        _noted[-1].append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes what ``new_path`` named and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a few numbers that one file may hold.
FILE_ROWS = 200_000


def materialize(df: DataFrame, what: str = "table", rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    ``rows``, if its size is known, makes files of at most about ``FILE_ROWS`` each, however many partitions it has.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_rows(docs: DataFrame, columns: list) -> DataFrame:
    """``columns`` of the rows with ``row_``, a number each: stored, so that every later scan sees the same numbers."""
    return materialize(docs.select(*columns, F.monotonically_increasing_id().alias("row_")), "rows")


#: Columns that hold the hashes of a text.
TEXT = ("t1", "t2")


def text_key(text: str = "text_") -> list[Column]:
    """128 bits of hashes by which a text is found again in the documents, whatever the order they are read in."""
    return [F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2")]


def carried(keep: list[str], own: list[str]) -> list[str]:
    """The columns to carry: those of ``keep`` but for names that the operator itself gives to a column."""
    return [c for c in keep if c not in own]


def words_of(text: Column) -> Column:
    """Array of the runs of other characters than ASCII white space; empty for null or blank text."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body`` with ``value`` bound once per row, for native expressions that use it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


_state: dict = {}


def worker_state(key: tuple, make):
    """What a Python worker keeps from task to task: one thing only, so that what an operator remembers makes room for the next."""
    if key not in _state:
        _state.clear()
        gc.collect()
        _state[key] = make()
    return _state[key]
