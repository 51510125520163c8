"""A corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
Stages return the columns of ``documents``; the last adds what the mix takes of each row.

Edge cases: empty tables give an empty result; a null text counts as empty, and fails the quality rules; texts of
any length are taken whole; rows whose doc_id is null are documents of their own, rows that share a doc_id are one
document, of which the near-duplicates stage keeps one row; doc_id is of an integer type; columns beside those of ``documents`` are carried,
whatever their names, but for the four that the mix adds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from swarmframe.llm import decontaminate, mixing, near_dup, quality_rules, suffix_dedup
from swarmframe.llm.common import checkpoint_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return quality_rules.keep_good(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of least id."""
    return near_dup.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that occur earlier are cut out; every document stays, if with a shorter text."""
    return suffix_dedup.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with the words it takes of each."""
    return mixing.in_the_mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("decontamination", decontamination), ("mixture", mixture)]

#: The forest, the signatures and the alignment have no SQL form; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Their tables lie beside the checkpoints, which driver and executors share; each goes when the next is written, the last one stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
