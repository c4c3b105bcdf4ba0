"""Corpus pipeline: quality, line dedup, near-duplicate documents, mixing, packing; each stage works on what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirespan.llm.common import stored
from wirespan.llm.line_dedup import dedup_lines
from wirespan.llm.mixing import mixed_rows
from wirespan.llm.ngram_join import one_of_each
from wirespan.llm.packing import pack_documents
from wirespan.llm.quality import keep_good
from wirespan.llm.queries import BYTE_VOCABULARY, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those here, accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated chunks of lines."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar word shingles, that with the smallest doc_id."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of each piece of each document in sequences of 1024 tokens."""
    packed = pack_documents(docs, vocabulary(BYTE_VOCABULARY))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the classifier, the components or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
