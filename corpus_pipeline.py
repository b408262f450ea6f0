"""From raw documents to packed training batches.

run() applies STAGES to the documents table of sf_dir. Each stage's result is
written as Parquet in the shared folder and read again as the next one's input.
All stages but the last return the columns of documents, whatever their names.
Null, empty and very long texts, repeated rows and null ids are treated as the
stage's operator says; an empty table gives an empty result.
"""

from pyspark.sql import DataFrame

from docloom.llm.common import stage, table
from docloom.llm.exact_dedup import keep_distinct
from docloom.llm.language_id import keep_identified
from docloom.llm.near_dedup import keep_representatives
from docloom.llm.packing import pack


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go, each by its own text: null, empty and letter-free texts among them (keep_identified)."""
    return keep_identified(docs)


def exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays; of rows that repeat id and text, one (keep_distinct)."""
    return keep_distinct(docs)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the one with the smallest id stays, and so do rows with a null id (keep_representatives)."""
    return keep_representatives(docs)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed: pieces with their texts, in batches (pack)."""
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Hypervectors and near-duplicate links can't be stated in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs, _ = stage(function(spark, docs, sf_dir), name)
    return docs
