"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.encode import token_ids
from inkweave.llm.leakage import leaked_items
from inkweave.llm.neardup import NearDuplicates, near_duplicates
from inkweave.llm.pairs import broken_pairs, trace_pairs
from inkweave.llm.spans import shared_spans
from inkweave.session import table


def _ideas(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    ideas = table(spark, sf_dir, "base_ideas").select(F.col("id").alias("rec"), F.col("description").alias("text"))
    decided = table(spark, sf_dir, "decisions").select(F.col("decision_id").alias("rec"), F.col("idea.idea").alias("text"))
    return near_duplicates(ideas.unionByName(decided), "rec", "text", "0.7", 24)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records, of ideas and decisions, with nearly the same idea."""
    return _ideas(spark, sf_dir).pairs()


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of ideas and decisions with its class of equal word sets and the classes linked to it."""
    return _ideas(spark, sf_dir).classes()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers and reasonings of evaluation traces, with their kind of defect."""
    return broken_pairs(trace_pairs(table(spark, sf_dir, "eval_traces"))).withColumnRenamed("id", "trace_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return token_ids(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items of which they hold ten words in a row."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the characters that lie in a span of 200 that another document has."""
    return shared_spans(table(spark, sf_dir, "documents"), at="created_at")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    return {"p1_found": p1_found, "p1_classes": p1_classes, "p3_found": p3_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}
