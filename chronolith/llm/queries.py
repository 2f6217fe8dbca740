"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm.packing import pack_documents
from chronolith.llm.sentences import sentences
from chronolith.llm.tokenize import encode, token_counts
from chronolith.runtime import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def p8_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_counts, p8_placement, p9_found)}

ORACLE: dict[str, str] = {}
