"""A corpus pipeline of five stages: each takes what the one before has kept, and what it decides takes effect.

Quality (rows scored under 0.3 go), near duplicates (one document of each group stays), benchmark passages (documents that
hold one go), personal data (masked), and the mix of sources (rows taken, with `copies`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pulsegrain.llm.common import checkpoint_folder, table
from pulsegrain.llm.decontamination import decontaminate
from pulsegrain.llm.mixing import mix
from pulsegrain.llm.ngram_join import keep_one_of_each_group
from pulsegrain.llm.pii import pii_mask
from pulsegrain.llm.quality_classifier import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier scores 0.3 or more, learned from the labels of `sf_dir`. Null and empty texts are
    scored as empty ones; without two positives to learn from all rows stay; an empty table gives no rows."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of least id, a null one last. Texts without words all stay."""
    return keep_one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in which no item of the benchmark occurs. Null texts hold none; an empty benchmark leaves all rows."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their texts replaced by its kind. Null texts stay null."""
    return pii_mask(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix of sources takes, with how many `copies`. Texts without words are never taken."""
    return mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("mixing", mixing)]

#: Models are trained and spans are found by code that SQL doesn't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each stage's rows are written as Parquet to the folder of checkpoints and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
