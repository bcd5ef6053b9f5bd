"""Projections, checks and listings of records, and versions of edited outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkweave.session import cut


def projected(df: DataFrame, fields: list[str]) -> DataFrame:
    """The declared fields in their order; those the frame lacks are null."""
    return df.select(*(F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields))


def field_rules(schema: T.StructType, overrides: dict[str, dict] | None = None) -> dict[str, dict]:
    """For each field of a schema whether it may be edited and how: texts are replaced, booleans toggled,
    objects edited by key. Overrides of fields that aren't there raise."""
    kinds = {T.StringType: "string", T.BooleanType: "boolean", T.MapType: "object", T.StructType: "object", T.VariantType: "object"}
    rules = {f.name: {"kind": kinds.get(type(f.dataType), "other"), "editable": type(f.dataType) in kinds} for f in schema.fields}
    for name, rule in (overrides or {}).items():
        if name not in rules:
            raise ValueError(f"unknown field: {name}")
        rules[name] |= rule
    return rules


def first_error(rules: dict[str, dict], present: dict[str, Column], kinds: dict[str, Column]) -> Column:
    """The first thing wrong with a record, in the order of the fields: missing, null though editable, of a
    type that can't be edited, a name with a dot; null if nothing is."""
    found = []
    for name, rule in rules.items():
        found.append(F.when(~present[name], F.lit(f"missing field: {name}")))
        if rule["editable"]:
            found.append(F.when(kinds[name] == "null", F.lit(f"null field: {name}")))
            found.append(F.when(~kinds[name].isin("string", "boolean", "object", "null"), F.lit(f"unsupported type: {name}")))
        if "." in name:
            found.append(F.lit(f"dotted name: {name}"))
    return F.coalesce(*found, F.lit(None).cast("string"))


def json_kind(text: Column | str, key: str) -> Column:
    """The JSON type of a member of a JSON text; null where it is missing."""
    value = F.try_variant_get(F.try_parse_json(text), f"$.{key}", "variant")
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None).when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").otherwise("number")
    )


def matching(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """The rows that equal all filters; ``exported`` asks whether ``exported_at`` is there. Filters of unknown columns are ignored."""
    for name, value in filters.items():
        if name == "exported":
            df = df.where(F.col("exported_at").isNotNull() if value else F.col("exported_at").isNull())
        elif name in df.columns:
            df = df.where(F.col(name) == F.lit(value))
    return df


def newest(df: DataFrame, at: str, key: str, limit: int = 5) -> DataFrame:
    """The latest records numbered from 1: a top-k and a number, in one order."""
    top = df.orderBy(F.desc_nulls_last(at), key).limit(limit)
    return top.withColumn("number", F.row_number().over(Window.orderBy(F.desc_nulls_last(at), key)))


def by_time_text(df: DataFrame, key: str, at: str) -> DataFrame:
    """Keys in the order of the text of their time, missing ones first; the order is the column ``place``; equal rows share one.

    Rows are sorted in ranges, numbered within each, and moved on by the rows of the ranges before, so that no task has all.
    """
    rows = df.select(key, F.coalesce(F.col(at).cast("string"), F.lit("")).alias("at_text"))
    order = [F.col("at_text"), F.asc_nulls_first(key)]
    parts = cut(rows.distinct().repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inside = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__rows"))  # as many as there are ranges
    before = counts.withColumn("__before", F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).select("__part", "__before")
    placed = inside.join(before, "__part").select("at_text", F.col(key).alias("__key"), (F.col("__before") + F.col("__n")).cast("int").alias("place"))
    return rows.join(placed, (rows["at_text"] == placed["at_text"]) & rows[key].eqNullSafe(F.col("__key"))).select(rows[key], rows["at_text"], "place")


def step_files(files: DataFrame, name: str) -> DataFrame:
    """Files of step outputs by step: whether there are a raw and a current one, how many edits, the last edit's number.

    Edits are told by their number, not by the order of their names, so the tenth comes after the ninth.
    """
    part = lambda i: F.regexp_extract(name, r"^(.*?)_(raw|current|edit_(\d+))\.json$", i)
    parsed = files.select(part(1).alias("step"), part(2).alias("kind"), F.try_to_number(part(3), F.lit("999999999")).cast("long").alias("n")).where("step <> ''")
    return parsed.groupBy("step").agg(
        F.bool_or(F.col("kind") == "raw").alias("has_raw"), F.bool_or(F.col("kind") == "current").alias("has_current"), F.count("n").alias("edits"), F.max("n").alias("last_edit")
    )


def with_files(records: DataFrame, path: str, files: DataFrame, name: str) -> DataFrame:
    """Only the records whose file is there."""
    return records.where(F.col(path).isNotNull()).join(files.select(F.col(name).alias(path)).distinct(), path, "left_semi")


def with_status(items: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    """Items with the status of their own file, which overrides the embedded one; items without one are incomplete and left out."""
    return items.drop("status").join(statuses.select(key, "status"), key)


def examples_block(intents: DataFrame, name: str, examples: str) -> DataFrame:
    """One text with the intents that have examples, each with its own as a list, by name."""
    blocks = intents.where(F.size(examples) > 0).select(name, F.concat(F.col(name), F.lit(":\n"), F.array_join(F.transform(examples, lambda e: F.concat(F.lit("- "), e)), "\n")).alias("block"))
    return blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "block"))), lambda r: r["block"]), "\n\n").alias("examples"))


def tail_of(index: Column, most_chars: int, sizes: tuple[int, ...] = (50, 20, 10, 5)) -> Column:
    """The last rows of an array of texts, as many of the first size whose text is short enough, else of the least."""
    cuts = [F.slice(index, F.greatest(F.size(index) - n + 1, F.lit(1)), n) for n in sizes]
    return F.coalesce(*(F.when(F.char_length(F.array_join(c, "\n")) <= most_chars, c) for c in cuts), cuts[-1])


def item_summaries(items: DataFrame, summary: Column | None = None) -> DataFrame:
    """Items as nested records for a snapshot: ``id`` and ``record``, with type, description, status (with the time of export as ISO text) and a summary."""
    exported = F.date_format("exported_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    status = F.struct(*(F.col(f"status.{n}").alias(n) for n in ("branch", "substate", "flags", "approved")), exported.alias("exported_at"))
    whole = F.struct("id", F.col("item_type").alias("type"), "description", status.alias("status"), (F.lit(None).cast("string") if summary is None else summary).alias("summary"))
    return items.select("id", whole.alias("record"))


#: The parts of a trace that are set, of which the last counts, and those that are added to.
SET_PARTS, ADDED_PARTS = ("prompt", "intent_llm", "intent_rule_based", "final_intent", "agent_response"), ("engine_calls", "errors")


def collected_traces(events: DataFrame, key: str, order: str) -> DataFrame:
    """One trace document for each case from its recorded events ``key, order, part, value``.

    Parts that are set hold the last value recorded, null if there was none; ``engine_calls`` and
    ``errors`` hold all of theirs, in order (a case has as many as one conversation). Other parts are ignored.
    """
    last = [F.max_by(F.when(F.col("part") == p, F.col("value")), F.when(F.col("part") == p, F.col(order))).alias(p) for p in SET_PARTS]
    listed = [F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct(F.col(order).alias("o"), F.col("value").alias("value"))))).alias(p) for p in ADDED_PARTS]
    found = events.groupBy(key).agg(*last, *listed)
    return found.select(key, *SET_PARTS, *(F.col(f"{p}.value").alias(p) for p in ADDED_PARTS))


def relevant_context(intents: DataFrame, uses: DataFrame, types: DataFrame, objects: DataFrame) -> DataFrame:
    """The session's objects that each intent needs: ``id`` and ``context``, a map of the types' context keys to their objects.

    ``intents`` has ``id, session, intent``; ``uses`` has ``intent, type``; ``types`` has ``type, context_key,
    fields`` (an array of the fields shown, null or empty for all); ``objects`` has ``session, type, ord, object``
    (a map). Intents without any object aren't in the result. A session's objects of a type are one conversation's.
    """
    wanted = uses.join(types, "type").distinct()
    shown = F.map_filter("object", lambda k, _: F.coalesce(F.size("fields") <= 0, F.lit(True)) | F.array_contains("fields", k))
    found = intents.join(wanted, "intent").join(objects, ["session", "type"]).select("id", F.coalesce("context_key", F.lower("type")).alias("context_key"), "ord", shown.alias("object"))
    listed = found.groupBy("id", "context_key").agg(F.array_sort(F.collect_list(F.struct("ord", F.map_entries("object").alias("e")))).alias("rows"))
    listed = listed.select("id", "context_key", F.transform("rows", lambda r: F.map_from_entries(r["e"])).alias("objects"))
    return listed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("context_key", "objects"))).alias("context"))


DECISION_JSON = "struct<decision_id:string,turn_id:string,timestamp:string,idea:struct<key:string,idea:string>,rationale:string,status:string>"


def decisions_of(df: DataFrame, buckets: str, *keep: str) -> DataFrame:
    """The decisions in a JSON text of buckets (``{"accepted": [...], ...}``), one a row, with some columns: their
    ``bucket``, their place in it and their members, times as timestamps (``Z`` is UTC), unknown members left out.

    A text that is no such object has no rows; a decision without a status has its bucket's.
    """
    parsed = F.from_json(buckets, f"map<string,array<{DECISION_JSON}>>")
    rows = df.select(*keep, F.explode(parsed).alias("bucket", "__rows")).select(*keep, "bucket", F.posexplode("__rows").alias("place", "d"))
    return rows.select(*keep, "bucket", "place", "d.decision_id", "d.turn_id", F.try_to_timestamp("d.timestamp").alias("ts"), F.col("d.idea.key").alias("key"), F.col("d.idea.idea").alias("idea"), "d.rationale", F.coalesce("d.status", "bucket").alias("status"))


def action_flags(items: DataFrame) -> DataFrame:
    """Items' status with whether they wait for approval, and whether they are ready to go on."""
    waits = F.coalesce(F.col("status.requires_approval") & ~F.coalesce("status.approved", F.lit(False)), F.lit(False))
    return items.select("id", F.col("status.branch").alias("branch"), F.col("status.substate").alias("substate"), waits.alias("needs_approval"), (F.col("status").isNotNull() & ~waits).alias("ready"))


def idea_records(ideas: DataFrame, small: bool = False) -> DataFrame:
    """Ideas as records for a summary: id, description and approval, or also type, style, metadata and times as ISO text."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
    more = [] if small else [F.col("idea_type").alias("type"), "style", "metadata", *map(iso, ("created_at", "updated_at", "exported_at"))]
    return ideas.select("id", "description", "approved", *more)
