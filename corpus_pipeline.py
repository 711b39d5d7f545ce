"""Corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before wrote, and all but the last
return the columns of documents. Further columns of docs are left behind. A document whose words all lie in
passages that stand earlier goes in line dedup; of each class of near copies the row of the smallest doc_id
stays; documents that are rejected as toxic or contaminated go. Null texts and empty texts pass every stage but packing as
they are, null ids and repeated rows are rows of their own, an empty table stays empty.

The stages of one pipeline follow one another in a session, each after the result of the one before is written. So a stage
begins by removing the tables that the operators of the one before stored for it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from planweave.llm.common import drop_path, new_path, noted, table
from planweave.llm.queries import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts from this Jaccard similarity of word shingles on, in hundredths, are near copies. The 85 of op9 is that query's own.
NEAR_PERCENT = 80


_left: list[str] = []


def stage(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that clears away what the one before it stored, and notes what it stores itself."""

    @functools.wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            drop_path(spark, _left.pop())
        with noted() as paths:
            out = build(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return toxicity.score(docs, model, COLUMNS).where("score < 0.5").select(COLUMNS)


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(docs, [c for c in COLUMNS if c != "text"])
    emptied = (F.col("n_deleted_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("n_deleted_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~emptied).withColumn("n_chars", n_chars).select(COLUMNS)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in COLUMNS if c != "doc_id"]
    return near_dedup.near_dedup(docs, NEAR_PERCENT, rest).where("first").select(COLUMNS)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The trained classifier and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, build in STAGES:
        path = new_path(spark, f"stage-{name}")
        build(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
