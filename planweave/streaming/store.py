"""Versions of tables that change together: written first, then named by a pointer that is moved in one step.

A commit writes the tables that change into a folder of its own and exchanges the pointer, a small file that names the
present place of every table and the last batch of each stream. Whoever reads the pointer sees all tables of one commit, the
former or the new one. A batch that comes again (its stream has one of its number or later) changes nothing; one that failed
before the pointer moved is written anew. Folders that neither the pointer nor the one before names are removed. There is
one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "pointer.json"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, folder: str) -> dict:
    """What the pointer names: ``tables`` (name to place), ``former`` places, ``batches`` (stream to number); empty without one."""
    at, fs = _fs(spark, f"{folder}/{POINTER}")
    if not fs.exists(at):
        return {"tables": {}, "former": [], "batches": {}}
    return json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/{POINTER}").collect()))


def move_pointer(spark: SparkSession, folder: str, state: dict) -> None:
    """Write the new pointer beside the old one, then rename it over that: atomic where the file system's rename is."""
    new, fs = _fs(spark, f"{folder}/.pointer-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    at = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}"))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), at, how)


def current(spark: SparkSession, folder: str, table: str = "projects") -> DataFrame | None:
    """A table as the pointer names it."""
    place = pointer(spark, folder)["tables"].get(table)
    return None if place is None else spark.read.parquet(f"{folder}/{place}")


def done(spark: SparkSession, folder: str, stream: str, batch: int) -> bool:
    return pointer(spark, folder)["batches"].get(stream, -1) >= batch


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], stream: str, batch: int) -> None:
    """Next version of ``tables``; those that are not named stay as they are."""
    state = pointer(spark, folder)
    if state["batches"].get(stream, -1) >= batch:
        return
    name = f"v-{stream}-{batch}"
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/{table}")
    places = state["tables"] | {t: f"{name}/{t}" for t in tables}
    move_pointer(spark, folder, {"tables": places, "former": sorted(set(state["tables"].values())), "batches": state["batches"] | {stream: batch}})
    clean(spark, folder)


def clean(spark: SparkSession, folder: str) -> None:
    """Removes the places that neither the pointer nor the one before names."""
    state = pointer(spark, folder)
    named = {*state["tables"].values(), *state["former"]}
    at, fs = _fs(spark, folder)
    for version in fs.listStatus(at):
        if version.isDirectory() and version.getPath().getName().startswith("v-"):
            tables = list(fs.listStatus(version.getPath()))
            gone = [t for t in tables if f"{version.getPath().getName()}/{t.getPath().getName()}" not in named]
            for t in gone:
                fs.delete(t.getPath(), True)
            if len(gone) == len(tables):
                fs.delete(version.getPath(), True)
