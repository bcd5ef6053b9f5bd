"""The registered queries on drifting schemas, snapshots and nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.operators.drift import Parents, consistent_table, schema_changes
from inkweave.operators.nested import braced_member, flattened, latest, step_members, whole
from inkweave.operators.snapshots import hashed_rows, snapshot_changes, validity_intervals
from inkweave.session import cut, table

TURN_VALUES = ["decisions", "strategy_outputs", "criteria_results"]
#: The objects of record files whose inner keys are fields, with those keys, and the fields of open content.
PARENTS = Parents(
    {"intent_llm": ("intent", "item_id", "step_name", "edit_text", "parameters", "reasoning"), "status": ("branch", "substate", "approved", "requires_approval", "flags")},
    ("parameters", "flags", "raw", "current"),
)
#: Fixed value: the delivery whose criteria results are laid flat.
LAST_SNAPSHOT = 9


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a field between a file and the one before it."""
    return schema_changes(table(spark, sf_dir, "raw_deliveries"), parents=PARENTS)


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all files, with every field under its first name and in its first type, as sorted JSON."""
    found = consistent_table(table(spark, sf_dir, "raw_deliveries"), parents=PARENTS, kinds={"intent_llm": "trace", "status": "status"}, otherwise="step")
    entries = F.array_sort(F.map_entries("fields"))
    return found.select("kind", "feed", "file_no", "rec_id", F.to_json(entries).alias("fields"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns added, removed and changed at each delivery."""
    found = snapshot_changes(table(spark, sf_dir, "turn_snapshots"), "snapshot_no", "turn_id", TURN_VALUES, "loaded_at")
    return found.select(F.col("snapshot").alias("snapshot_no"), F.col("key").alias("turn_id"), "change_kind")


def p4_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn the runs of deliveries in which it has one value, by the deliveries' ranks."""
    rows = hashed_rows(table(spark, sf_dir, "turn_snapshots"), "snapshot_no", "turn_id", TURN_VALUES, "loaded_at")
    return validity_intervals(cut(rows)).select(F.col("key").alias("turn_id"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def _nested(spark: SparkSession, sf_dir: str, content: bool) -> DataFrame:
    traces = table(spark, sf_dir, "eval_traces").groupBy("trace_id").agg(F.max("intent_llm").alias("intent_llm"))
    turns = table(spark, sf_dir, "turn_snapshots").where(F.col("snapshot_no") == LAST_SNAPSHOT)
    turns = turns.withColumn("turn_id", F.lower(F.regexp_replace("turn_id", r"(?U)^\s+|\s+$", "")))
    turns = latest(turns, ["turn_id"], "loaded_at", ["criteria_results"])
    items = latest(table(spark, sf_dir, "workflow_items"), ["id"], "updated_at", ["step_outputs"])
    return reduce(
        DataFrame.unionByName,
        [
            flattened(traces, "trace_id", "intent_llm", braced_member("intent_llm", "parameters"), "eval_traces", content=content),
            flattened(turns, "turn_id", "criteria_results", whole("criteria_results"), "turn_snapshots", content=content),
            flattened(items, "id", "step_outputs", step_members("step_outputs", "current"), "workflow_items", content=content),
        ],
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is an array element, with the object around it."""
    return _nested(spark, sf_dir, content=False)


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as related flat tables: ``entity`` names the table (the path without indexes), ``node`` has the values."""
    entity = F.regexp_replace("node_path", r"\[\d+\]", "")
    return _nested(spark, sf_dir, content=True).withColumn("entity", F.regexp_extract(entity, r"([^.]*)$", 1))


def queries() -> dict:
    """By name."""
    return {"p2_found": p2_found, "p2_table": p2_table, "p4_found": p4_found, "p4_intervals": p4_intervals, "p5_found": p5_found, "p5_tables": p5_tables}
