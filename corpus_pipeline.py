"""From raw documents to packed training sequences.

Each stage takes the documents that the one before it kept.  All but the last return
the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from settlespark.llm.decontaminate import drop_contaminated
from settlespark.llm.exact_dedup import drop_exact_copies
from settlespark.llm.near_dedup import drop_near_copies
from settlespark.llm.packing import pack_sequences
from settlespark.llm.quality import drop_low_quality
from settlespark.plans.skew import checkpoint_dir, delete, kept_paths


# Documents are near copies from this share of common five-word shingles on.
NEAR_PERCENT = 80
# Batches of rows on their way to Python and back, which both sides hold outside the heap.
BATCH_BYTES = "4m"

_left: list[str] = []


def _stage(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that first deletes what the one before it kept in the shared folder.

    That stage's result has been written by then; should ``docs`` still read such a
    table, all of them stay.  The result is written after the stage has returned, so the
    session keeps the bound on batches.
    """
    @wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        names = {path.rpartition("/")[2] for path in _left}
        if _left and not any(names & set(file.split("/")) for file in docs.inputFiles()):
            delete(spark, _left)
            _left.clear()
        with kept_paths() as paths:
            result = step(spark, docs, sf_dir)
        _left.extend(paths)
        return result
    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, percent=NEAR_PERCENT)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The classifier and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    delete(spark, _left)
    _left.clear()
    return docs
