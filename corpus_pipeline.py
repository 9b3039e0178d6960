"""From documents to packed training sequences: five stages, each one operator of tideglass.llm.

A stage takes (spark, docs, sf_dir), where docs is all that the stage before
kept, and returns a DataFrame; all but the last return the columns of
``documents``.  run() writes each stage's rows as Parquet to the shared folder
and reads them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideglass.llm import exact_dedup, jaccard, packing, quality, simhash, toxicity
from tideglass.llm.common import crc_mod, documents, held_tables, labels, sweep, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go."""
    return quality.keep(docs, labels(spark, sf_dir).where(crc_mod("doc_id", 5) != 0))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects (score of 0.5 or more) go."""
    return toxicity.keep(docs, labels(spark, sf_dir).where(crc_mod("doc_id", 5) != 0))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one stays."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies go: first all but one of those that a Jaccard of 0.8 or more over 5-word shingles connects, then of those that SimHash links of three bits or fewer connect; that with the smallest doc_id stays."""
    return simhash.deduplicate(written(jaccard.deduplicate(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of what is left, with its sequence and offset."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Classifiers, XXH64 links and packing are not SQL; tests/llm/test_pipeline.py holds each stage against its definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, before = documents(spark, sf_dir), held_tables()
    for _, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir))
        sweep(spark, before, rows)  # the stage's own tables, and the rows of the stage before
    return STAGES[-1][1](spark, rows, sf_dir)
