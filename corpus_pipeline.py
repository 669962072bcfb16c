"""A training corpus from raw documents: five operators of ledgerloom.llm in a row, each stage written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import decontamination, line_dedup, near_dup, packing, quality
from ledgerloom.llm.lineage import ARROW_ROWS, batches_of, drop, shared_folder
from ledgerloom.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows with texts that go to Python at once.
BATCH = 1000


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, with at most ``BATCH`` rows in a batch. Its result is computed when it is written, so the setting stays; :func:`run` takes it back at its end."""

    @wraps(stage)
    def small(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = int(spark.conf.get(ARROW_ROWS))
        spark.conf.set(ARROW_ROWS, min(BATCH, before) if before > 0 else BATCH)
        return stage(spark, docs, sf_dir)

    return small


@in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, weights, keep=COLUMNS)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


@in_small_batches
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; documents that had text and keep none go with them."""
    had = docs.withColumn("__had", F.length(F.trim("text")) > 0)
    out = line_dedup.remove_repeated_lines(had)
    out = out.where(~F.coalesce("__had", F.lit(False)) | (F.length(F.trim("text")) > 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id. Rows without id stay."""
    gone = near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return near_dup.without_ids(docs, gone).select(*COLUMNS)


@in_small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows in 5 % of their words or more go; from the others, spans of a window's length or more are cut out."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), keep=["lang", "source"], clean=decontamination.WINDOW)
    out = found.where(~decontamination.contaminated()).withColumnRenamed("id", "doc_id")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learning, minwise branching, an automaton and a tokenizer are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage returns is a Parquet table in the shared folder, of which a stage's input goes once its result is written."""
    root, before = shared_folder(spark), None
    docs = table(spark, sf_dir, "documents")
    with batches_of(spark, BATCH):
        for name, stage in STAGES:
            path = f"{root}/ledgerloom-{uuid.uuid4().hex}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs, done = spark.read.parquet(path), before
            drop(done)
            before = docs
    return docs
