"""Queries on projections, checks, listings and versions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions.text import stripped
from inkweave.operators.keyed import top_per_key
from inkweave.operators.records import by_time_text, examples_block, field_rules, first_error, json_kind, newest, projected, step_files, tail_of, with_files
from inkweave.session import table


def projected_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas as the declared fields, one of which they lack."""
    return projected(table(spark, sf_dir, "base_ideas"), ["id", "idea_type", "approved", "reviewer"]).distinct()


def structure_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong first with the metadata of ideas, against their declared fields."""
    rows = table(spark, sf_dir, "base_ideas").select("id", "metadata").distinct()
    rules = field_rules(spark.range(0).selectExpr("'' AS origin", "'' AS topic", "0L AS turn").schema)
    kinds = {name: json_kind("metadata", name) for name in rules}
    error = first_error(rules, {name: kind.isNotNull() for name, kind in kinds.items()}, kinds)
    return rows.select(F.coalesce(error, F.lit("ok")).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def newest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest items, numbered."""
    items = table(spark, sf_dir, "workflow_items").groupBy("id").agg(F.max(F.unix_micros(F.col("created_at").cast("timestamp"))).alias("at_us"))
    return newest(items, "at_us", "id").select("id", "at_us", F.col("number").cast("long").alias("number"))


def turns_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each delivery in the order of their first time: where in it each stands."""
    turns = table(spark, sf_dir, "turn_snapshots").select(F.lower(stripped("turn_id")).alias("turn_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at")).groupBy("turn_id").agg(F.min("at").alias("at"))
    return by_time_text(turns, "turn_id", "at").select("turn_id", F.col("place").cast("long").alias("place"))


def edit_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that step outputs name, by step."""
    outputs = F.from_json("step_outputs", "map<string,struct<raw:string,current:string,edits:array<string>>>")
    steps = table(spark, sf_dir, "workflow_items").select("id", "step_outputs").distinct().select("id", F.explode(outputs).alias("step", "o"))
    name = lambda suffix: F.concat("step", F.lit("_"), suffix, F.lit(".json"))
    edits = F.transform(F.coalesce("o.edits", F.array().cast("array<string>")), lambda e: F.concat(F.col("step"), F.lit("_"), e))
    listed = steps.select(F.explode(F.concat(F.when(F.col("o.raw").isNotNull(), F.array(name(F.lit("raw")))).otherwise(F.array().cast("array<string>")), edits)).alias("file"))
    return step_files(listed, "file")


def items_with_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose parent is there."""
    items = table(spark, sf_dir, "workflow_items")
    return with_files(items.select("id", "parent_id").distinct(), "parent_id", items.select("id"), "id")


def intent_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of the shortest prompts of each final intent."""
    prompts = table(spark, sf_dir, "eval_traces").where("final_intent is not null and prompt is not null").groupBy("final_intent").agg(F.array(F.min_by("prompt", F.struct(F.char_length("prompt"), "prompt"))).alias("examples"))
    return examples_block(prompts, "final_intent", "examples")


def index_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ideas of each type that fit 600 characters."""
    ids = table(spark, sf_dir, "base_ideas").where("id is not null").select(F.coalesce("idea_type", F.lit("none")).alias("idea_type"), "id").distinct()
    last = top_per_key(ids, ["idea_type"], 50, F.desc("id"))  # no more are ever shown, so no more are gathered
    ideas = last.groupBy("idea_type").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return ideas.select("idea_type", F.array_join(tail_of(F.col("ids"), 600), "\n").alias("tail"))


QUERIES = {
    "projected_ideas": (projected_ideas, "SELECT DISTINCT id, idea_type, approved, NULL::VARCHAR AS reviewer FROM base_ideas"),
    "structure_errors": (structure_errors, """
WITH m AS (SELECT DISTINCT id, CASE WHEN json_valid(metadata) THEN metadata END AS j FROM base_ideas), k AS (SELECT json_type(j, '$.origin') AS o, json_type(j, '$.topic') AS t, json_type(j, '$.turn') AS n FROM m)
SELECT CASE WHEN o IS NULL THEN 'missing field: origin' WHEN o = 'NULL' THEN 'null field: origin' WHEN o NOT IN ('VARCHAR', 'BOOLEAN', 'OBJECT') THEN 'unsupported type: origin'
  WHEN t IS NULL THEN 'missing field: topic' WHEN t = 'NULL' THEN 'null field: topic' WHEN t NOT IN ('VARCHAR', 'BOOLEAN', 'OBJECT') THEN 'unsupported type: topic' WHEN n IS NULL THEN 'missing field: turn' ELSE 'ok' END AS error, count(*) AS n FROM k GROUP BY 1"""),
    "newest_items": (newest_items, "SELECT id, max(epoch_us(created_at)) AS at_us, row_number() OVER (ORDER BY max(epoch_us(created_at)) DESC NULLS LAST, id) AS number FROM workflow_items GROUP BY id ORDER BY number LIMIT 5"),
    "turns_by_time": (turns_by_time, r"""
WITH t AS (SELECT lower(regexp_replace(turn_id, '^\s+|\s+$', '', 'g')) AS turn_id, coalesce(strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f'), '') AS at_text FROM turn_snapshots GROUP BY 1)
SELECT turn_id, dense_rank() OVER (ORDER BY at_text, turn_id) AS place FROM t"""),
    "edit_versions": (edit_versions, r"""
WITH d AS (SELECT DISTINCT id, step_outputs AS j FROM workflow_items WHERE json_valid(step_outputs)), s AS (SELECT unnest(json_keys(j)) AS step, j FROM d),
o AS (SELECT step, json_extract(j, '$."' || step || '"') AS o FROM s),
f AS (SELECT step, step || '_raw.json' AS file FROM o WHERE json_type(o, '$.raw') NOT IN ('NULL') UNION ALL SELECT step, step || '_' || unnest(json_extract_string(o, '$.edits[*]')) FROM o)
SELECT step, bool_or(file LIKE '%\_raw.json' ESCAPE '\') AS has_raw, bool_or(file LIKE '%\_current.json' ESCAPE '\') AS has_current, count(nullif(regexp_extract(file, '_edit_(\d+)\.json$', 1), '')) AS edits, max(nullif(regexp_extract(file, '_edit_(\d+)\.json$', 1), '')::BIGINT) AS last_edit FROM f GROUP BY step"""),
    "items_with_parent": (items_with_parent, "SELECT DISTINCT id, parent_id FROM workflow_items w WHERE EXISTS (SELECT 1 FROM workflow_items p WHERE p.id = w.parent_id)"),
    "intent_examples": (intent_examples, """
WITH p AS (SELECT final_intent, arg_min(prompt, (length(prompt), prompt)) AS e FROM eval_traces WHERE final_intent IS NOT NULL AND prompt IS NOT NULL GROUP BY 1)
SELECT string_agg(final_intent || ':' || chr(10) || '- ' || e, chr(10) || chr(10) ORDER BY final_intent) AS examples FROM p"""),
    "index_tails": (index_tails, """
WITH g AS (SELECT coalesce(idea_type, 'none') AS idea_type, list_sort(list(DISTINCT id)) AS ids FROM base_ideas WHERE id IS NOT NULL GROUP BY 1),
c AS (SELECT idea_type, [array_to_string(ids[-50:], chr(10)), array_to_string(ids[-20:], chr(10)), array_to_string(ids[-10:], chr(10)), array_to_string(ids[-5:], chr(10))] AS cs FROM g)
SELECT idea_type, coalesce(list_filter(cs, lambda x: length(x) <= 600)[1], cs[4]) AS tail FROM c"""),
}
