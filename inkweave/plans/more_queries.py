"""Queries on references, edits said in words, windows of samples and model functions, each with its SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import model
from inkweave.functions.geometry import css_color, svg_circle, svg_square, svg_text
from inkweave.functions.merging import upto
from inkweave.functions.text import answer_key, parsed_answer, rendered
from inkweave.operators.detections import clip_name, clip_samples, coarse_to_fine, sample_windows, strongest_frames
from inkweave.operators.keyed import rows_not_in, shared_tokens, top_per_key
from inkweave.operators.records import action_flags, collected_traces, decisions_of, idea_records, item_summaries, relevant_context
from inkweave.operators.sequences import laid_out
from inkweave.plans.event_queries import ITEMS_SQL, _detections, _groups, _items, _micros
from inkweave.plans.events import choices, session_references
from inkweave.plans.intents import local_edit, model_field, model_intent, model_parameters, model_valid
from inkweave.session import cut, table
from inkweave.sources.audio import chunked, decoded_rows, wav_bytes


def references_in_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What references said in chat sessions mean: their items come from the events, the references from their number."""
    events = table(spark, sf_dir, "actor_events").where("session_id is not null and item_id is not null and event_id is not null")
    once = events.groupBy("session_id", "item_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    few = top_per_key(once, ["session_id"], 5, F.asc("first"), F.asc("item_id"))  # no more are ever shown, so no more are gathered
    shown = few.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("first", "item_id"))).alias("rows"))
    shown = shown.join(once.groupBy("session_id").agg(F.max_by("item_id", "last").alias("last_item")), "session_id")
    listed = F.col("rows.item_id")
    said = ["", "the first one", "show me the SECOND", "3rd please", "last", "no such thing"]
    refs = F.array(*map(F.lit, said), F.concat(F.lit("item "), F.upper(F.col("last_item"))), F.lower("last_item"))
    rows = shown.select("session_id", "last_item", listed.alias("listed"), F.posexplode(refs).alias("n", "ref"))
    rows = rows.withColumn("listed", F.when(F.col("n") == 7, F.array().cast("array<string>")).otherwise(F.col("listed")))
    rows = rows.select(F.concat("session_id", F.lit("/"), F.col("n").cast("string")).alias("ref_id"), "ref", "last_item", "listed")
    return session_references(_items(spark, sf_dir).select("id", "label"), rows)


def choice_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten items about voices, searched among those on a branch."""
    items = table(spark, sf_dir, "workflow_items")
    return choices(items, "VOICE", "id", ["label", "description"], items.where("status.branch = 'default'").select("id")).select("id", F.col("place").cast("long").alias("place"), "outcome")


def local_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits said in words to the metadata of ideas."""
    said = ["replace the topic: red barn", "fix the origin", "shorten it: x", "delete the topic", "edit the colour: blue", "rewrite origin: desk: two"]
    meta = F.from_json("metadata", "map<string,string>")
    rows = table(spark, sf_dir, "base_ideas").select("id", "metadata").where("id is not null").distinct().select("id", meta.alias("m")).where("m is not null")
    rows = rows.select("id", "m", F.explode(F.array(*map(F.lit, said))).alias("message"))
    done = rows.select("id", "message", local_edit(F.col("m"), {"topic": "string", "origin": "string", "colour": "string"}, "message").alias("e"))
    return done.select("id", "message", "e.field", "e.kind", "e.value", "e.error", F.col("e.fields")["topic"].alias("topic"), F.col("e.fields")["origin"].alias("origin"))


def coarse_fine_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes inside the hours in which a group reaches its own threshold."""
    limits = spark.createDataFrame([("attention", 400.0), ("growth", 450.0)], "group_name string, threshold double")
    return coarse_to_fine(_detections(spark, sf_dir), _groups(spark), 3_600, 60, limits)


def strong_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a recording of an hour: the strong ones of two classes with their times."""
    frames = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.lit(1_000).alias("frames"), F.lit(3_600.0).alias("seconds"), F.create_map("event_type", "value").alias("scores"))
    return strongest_frames(frames, "click|error", 150.0).select("idx", "label", "score", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("samples"))


def _sum(values):
    return F.round(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), 6)


def windows_of_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as samples of 16 a second: windows of a second, every half second."""
    rows = _samples(spark, sf_dir).select("vec_id", F.explode(sample_windows(F.col("samples"), 16, 1.0, 0.5)).alias("w"))
    return rows.select("vec_id", "w.start", "w.end", _sum(F.col("w.part")).alias("total"))


def clips_of_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of embeddings as samples, from a time by their label, with their file's name."""
    start = F.lit(100) + F.col("label") * 130
    part = clip_samples(F.col("samples"), 16, start, start + 1_500)
    return _samples(spark, sf_dir).select("vec_id", clip_name("clip", start, start + 1_500).alias("file"), F.size(part).cast("long").alias("n"), _sum(part).alias("total"))


def turn_decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions inside the turns of each delivery, as typed rows."""
    turns = table(spark, sf_dir, "turn_snapshots").select("snapshot_no", "decisions").where("decisions is not null").distinct()
    rows = decisions_of(turns, "decisions", "snapshot_no")
    return rows.select("snapshot_no", "bucket", F.col("place").cast("long").alias("place"), "decision_id", "key", "rationale", "status")


def status_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' status as JSON text and back."""
    items = table(spark, sf_dir, "workflow_items").select("id", "status").distinct()
    back = F.from_json(F.to_json("status"), items.schema["status"].dataType.simpleString())
    return items.select("id", back.alias("s")).select("id", "s.branch", "s.substate", "s.approved", "s.requires_approval", "s.flags")


def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items wait for approval and which are ready."""
    return action_flags(table(spark, sf_dir, "workflow_items")).distinct()


def idea_record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas as full records, and how many have a small one."""
    ideas = table(spark, sf_dir, "base_ideas")
    small = idea_records(ideas, True).distinct().groupBy("id").agg(F.count("*").alias("small_records"))
    return idea_records(ideas).distinct().join(small, "id").select("id", "type", "approved", "created_at", "exported_at", "small_records")


def node_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as shapes of an SVG drawing: squares, hollow circles and names."""
    x, y = F.col("n_nationkey") * 10.5, F.col("n_regionkey") * 20.25
    shape = F.when(F.col("n_nationkey") % 2 == 0, svg_square(x, y, F.lit(8.0), F.lit("rgb(1,2,3)"))).otherwise(svg_circle(x, y, F.lit(4.0), F.lit("black")))
    return table(spark, sf_dir, "nation").select("n_nationkey", shape.alias("shape"), svg_text(x, y, F.concat(F.lit("<"), "n_name", F.lit("> & co")), 12).alias("label"))


FIELDS = {"topic": "string", "origin": "string"}


def model_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field that a backend picks for prompts: the first word of some length, which is seldom one."""
    def answer(prompt: str) -> str:
        n = len(_told(prompt, "Message: ")) % 4
        return json.dumps({"field": (None, "topic", "origin", "colour")[n]})

    rows = table(spark, sf_dir, "eval_traces").select("prompt").distinct()
    return model_field(rows, "prompt", FIELDS, lambda: model.EchoBackend(answer)).select("prompt", "field", "reason")


def model_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a backend finds sensible if they are short; removals aren't asked about."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit("name").alias("field"), F.when(F.col("p_partkey") % 3 == 0, "remove_key").otherwise("replace").alias("kind"))
    checked = model_valid(rows, "field", "p_name", "kind", lambda: model.EchoBackend(lambda p: json.dumps({"ok": len(_told(p, "Value: ")) % 2 == 0})))
    return checked.select("p_partkey", "valid")


def model_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents that a backend picks for prompts, some outside the contract."""
    contract = {"list_items": "lists", "describe_workflow": "describes"}

    def answer(prompt: str) -> str:
        n = len(_told(prompt, "Message: ")) % 4
        return "no JSON" if n == 3 else json.dumps({"intent": ("list_items", "describe_workflow", "fly")[n]})

    rows = table(spark, sf_dir, "eval_traces").select("prompt").distinct()
    return model_intent(rows, "prompt", contract, lambda: model.EchoBackend(answer)).select("prompt", "intent")


def model_found_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that a backend finds in prompts: a size, and a step for even ones."""
    def answer(prompt: str) -> str:
        n = len(_told(prompt, "Message: "))
        return json.dumps({"size": n, "step": "cut" if n % 2 == 0 else None, "other": 1})

    rows = table(spark, sf_dir, "eval_traces").select("prompt").distinct()
    found = model_parameters(rows, "prompt", ["size", "step"], lambda: model.EchoBackend(answer))
    return found.select("prompt", F.col("parameters")["size"].alias("size"), F.col("parameters")["step"].alias("step"), F.size("parameters").cast("long").alias("n"))


def item_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as nested records in JSON text: some of their members."""
    rows = item_summaries(table(spark, sf_dir, "workflow_items"), F.col("label")).select("id", F.to_json("record", {"ignoreNullFields": "false"}).alias("j"))
    get = lambda path: F.get_json_object("j", path)
    return rows.select("id", get("$.type").alias("kind"), get("$.status.branch").alias("branch"), get("$.status.approved").alias("approved"), get("$.status.exported_at").alias("exported_at"), get("$.summary").alias("summary")).distinct()


def trace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces taken apart into events, some set twice, and collected again."""
    rows = table(spark, sf_dir, "eval_traces").dropDuplicates(["trace_id"]).select("trace_id", "prompt", "final_intent", "errors", F.transform("engine_calls", lambda c: c["call"]).alias("calls"))
    rows = cut(rows)
    event = lambda part, n, value: F.struct(F.lit(part).alias("part"), n.cast("long").alias("n"), value.alias("value"))
    none = F.array().cast("array<struct<part:string,n:bigint,value:string>>")
    several = lambda part, name: F.coalesce(F.transform(name, lambda v, i: event(part, i + 10, v)), none)
    fixed = F.array(event("prompt", F.lit(1), F.lit("draft")), event("prompt", F.lit(2), F.col("prompt")), event("final_intent", F.lit(3), F.col("final_intent")), event("unknown", F.lit(4), F.lit("x")))
    events = rows.select("trace_id", F.explode(F.shuffle(F.concat(fixed, several("engine_calls", "calls"), several("errors", "errors")))).alias("e")).select("trace_id", "e.*")
    done = collected_traces(events, "trace_id", "n")
    joined = lambda name: F.array_join(name, "|", "-")
    same = done.join(rows.withColumnsRenamed({c: f"was_{c}" for c in ("prompt", "final_intent", "errors", "calls")}), "trace_id")
    equal = F.col("prompt").eqNullSafe(F.col("was_prompt")) & F.col("final_intent").eqNullSafe(F.col("was_final_intent")) & joined("errors").eqNullSafe(joined(F.coalesce("was_errors", F.array().cast("array<string>")))) & joined("engine_calls").eqNullSafe(joined(F.coalesce("was_calls", F.array().cast("array<string>"))))
    return same.select("trace_id", equal.alias("same"), F.col("agent_response").isNull().alias("unanswered"))


def intent_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as intents of their region's session: what of its regions and nations each needs."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    intents = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("session"), F.concat(F.lit("i"), (F.col("n_nationkey") % 3).cast("string")).alias("intent"))
    uses = spark.createDataFrame([("i0", "Region"), ("i0", "Nation"), ("i1", "Nation"), ("i2", "Nothing")], "intent string, type string")
    types = spark.createDataFrame([("Region", "regions", ["name"]), ("Nation", None, []), ("Nothing", "x", None)], "type string, context_key string, fields array<string>")
    made = lambda **c: F.map_from_arrays(F.array(*map(F.lit, c)), F.array(*c.values()))
    objects = region.select(F.col("r_regionkey").alias("session"), F.lit("Region").alias("type"), F.lit(0).cast("long").alias("ord"), made(name=F.col("r_name"), key=F.col("r_regionkey").cast("string")).alias("object"))
    objects = objects.unionByName(nation.select(F.col("n_regionkey").alias("session"), F.lit("Nation").alias("type"), F.col("n_nationkey").cast("long").alias("ord"), made(name=F.col("n_name"), key=F.col("n_nationkey").cast("string")).alias("object")))
    rows = relevant_context(intents, uses, types, objects).select("id", F.explode("context").alias("context_key", "objects"))
    return rows.select("id", "context_key", F.array_join(F.transform("objects", lambda o: o["name"]), "|").alias("names"), F.size(F.element_at("objects", 1)).cast("long").alias("fields"))


def wav_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as WAV files of sixteen samples a second, decoded again and cut into chunks of a second."""
    rows = _samples(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), F.lit(16).alias("rate"), "samples")
    coded = wav_bytes(rows, "samples", "rate").select("path", "content")
    back = decoded_rows(coded)
    return chunked(back, 1).select(F.col("path").cast("long").alias("vec_id"), F.col("chunk").cast("long").alias("chunk"), F.size("samples").cast("long").alias("n"), (F.round(F.aggregate(F.col("samples").cast("array<double>"), F.lit(0.0), lambda a, b: a + b), 2) + 0.0).alias("total"))


def typed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of answers as whole numbers, exactly and with booleans as numbers."""
    raw = F.concat(F.lit('<think>{}</think>so: {"flag": '), F.coalesce(F.col("approved").cast("string"), F.lit("null")), F.lit(', "n": '), F.char_length("id").cast("string"), F.lit(', "s": "7"}'))
    rows = table(spark, sf_dir, "base_ideas").where("id is not null").select("id", "approved", parsed_answer(raw).alias("a")).select("id", "approved", *(answer_key(F.col("a"), k, "bigint", e).alias(f"{k}_{'exact' if e else 'any'}") for k in ("flag", "n", "s") for e in (True, False)))
    return rows.distinct()


def steps_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as steps of their region: what is left of their outputs when the third is run again."""
    steps = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"), F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("outputs"))
    places = F.map_from_arrays(F.col("names"), F.transform("names", lambda _, i: i))
    left = upto(F.col("outputs"), places, F.element_at("names", 3))
    return steps.select(F.col("n_regionkey").alias("region"), F.array_join(F.array_sort(F.map_keys(left)), "|").alias("steps"))


def orders_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and priorities of finished orders that no open order has, repeats and all."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    both = ["o_custkey", "o_orderpriority"]
    return rows_not_in(rows.where("o_orderstatus = 'F'").select(*both), rows.where("o_orderstatus = 'O'").select(*both))


def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that prompts and answers share."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    rows = table(spark, sf_dir, "eval_traces").where("prompt is not null and agent_response is not null").select("trace_id", "prompt", "agent_response").distinct()
    shared = shared_tokens(words("prompt"), words("agent_response"))
    return rows.select("trace_id", F.array_join(F.array_sort(shared), " ").alias("shared"))


def rendered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces as messages in Markdown."""
    icon = F.when(F.size("errors") > 0, "!")
    text = rendered(icon, F.col("case_name"), F.col("prompt"), F.col("errors"), F.col("item_resolution.resolution_msg"))
    return table(spark, sf_dir, "eval_traces").select("trace_id", text.alias("message")).distinct()


def part_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as colours of two, three and four numbers."""
    n = F.col("p_size").cast("long")
    numbers = F.slice(F.array(n, n * 3 % 256, n * 7 % 256, n * 5), 1, (n % 3 + 2).cast("int"))
    return table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", css_color(numbers).alias("color"))


def block_layout_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of an order's items as blocks in a frame, whose gaps shrink where it is too small."""
    blocks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("height"), F.lit(12.0).alias("gap"))
    return laid_out(blocks, ["l_orderkey"], "l_linenumber", "height", "gap", frame=150.0).select("l_orderkey", "l_linenumber", F.round("top", 6).alias("top"), F.round("total_height", 6).alias("total_height"))


def _told(prompt: str, mark: str) -> str:
    return prompt.split(mark, 1)[1]


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to evaluation items by a backend that gives the question's length, as JSON only if it is even."""
    def answer(prompt: str) -> str:
        n = len(_told(prompt, "Question: "))
        return json.dumps({"answer": str(n)}) if n % 2 == 0 else f" about {n} "

    found = model.general_answer(table(spark, sf_dir, "eval_items"), "text", lambda: model.EchoBackend(answer))
    return found.select("item_id", "answer.answer", "answer.error")


def model_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of items edited by a backend that turns them to upper case."""
    rows = table(spark, sf_dir, "workflow_items").select("label").distinct().withColumn("how", F.lit("upper case"))
    found = model.edited(rows, "label", "how", lambda: model.EchoBackend(lambda p: json.dumps({"edited": _told(p, "Text: ").upper()})))
    return found.select("label", "answer.edited")


def model_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of items' types by a backend that finds the first letter and no other."""
    rows = table(spark, sf_dir, "workflow_items").select("item_type").distinct()
    found = model.extracted(rows, "item_type", ["letter", "colour"], lambda: model.EchoBackend(lambda p: json.dumps({"letter": _told(p, "Text: ")[:1], "other": 1})))
    return found.select("item_type", "answer.letter", "answer.colour", "answer.error")


def model_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and summaries of ideas' types."""
    def answer(prompt: str) -> str:
        text = _told(prompt, "Text: ")
        return json.dumps({"title": text.title(), "summary_short": text[:3], "source_url": None})

    found = model.described(table(spark, sf_dir, "base_ideas").select("idea_type").distinct(), "idea_type", lambda: model.EchoBackend(answer))
    return found.select("idea_type", "answer.title", "answer.summary_short", "answer.summary_long", "answer.source_url")


def model_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items that a backend grades as short."""
    found = model.graded(table(spark, sf_dir, "eval_items"), "text", "Is it short?", "ok", lambda: model.EchoBackend(lambda p: json.dumps({"ok": len(_told(p, "Text: ")) < 60})))
    return found.where(F.col("answer.ok") == "true").select("item_id", "answer.ok")


def model_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document kinds rewritten by a backend that gives no JSON."""
    rows = table(spark, sf_dir, "documents").select("doc_kind").distinct()
    found = model.rewritten(rows, "doc_kind", "Turn it round.", "text", lambda: model.EchoBackend(lambda p: _told(p, "Text: ")[::-1]))
    return found.select("doc_kind", F.col("answer.text").alias("turned"), "answer.error")


def model_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas by type, summarised by a backend that adds numbers: however a group is cut into parts, the sum of all lengths."""
    rows = table(spark, sf_dir, "base_ideas").select("id", "idea_type", F.char_length("description").cast("string").alias("size"))
    add = lambda p: json.dumps({"summary": str(sum(map(int, re.findall(r"\d+", _told(p, "Texts:")))))})
    found = model.summarized_groups(rows, ["idea_type"], "size", "id", lambda: model.EchoBackend(add), most_chars=200)
    return found.select("idea_type", F.col("answer.summary").cast("long").alias("chars"))


def model_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three words of each region's comment that a backend lists."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    found = model.listed(rows, "n_name", "List its letters.", "letters", lambda: model.EchoBackend(lambda p: json.dumps({"letters": [*_told(p, "Text: ")]})), most=3)
    return found.select("n_nationkey", F.col("place").cast("long").alias("place"), "value")


def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region compared as names of places."""
    nation = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    pairs = nation.join(nation.withColumnRenamed("n_name", "other"), "n_regionkey").where("n_name < other").withColumn("context", F.lit(None).cast("string"))

    def answer(prompt: str) -> str:
        a, b = _told(prompt, "Names: ").split("\n")[0].split(" | ")
        return json.dumps({"is_same": a[0] == b[0], "is_broad": len(a) > len(b)})

    found = model.compared(pairs, "n_name", "other", "context", "location", lambda: model.EchoBackend(answer))
    return found.select("n_name", "other", "answer.is_same", "answer.is_broad")


def model_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of any keys for nations, some of them no JSON."""
    def answer(prompt: str) -> str:
        name = _told(prompt, "Text: ")
        return json.dumps({"name": {"first": name[0]}, "size": len(name)}) if name[0] > "F" else name

    found = model.metadata(table(spark, sf_dir, "nation").select("n_name"), "n_name", "Describe it.", lambda: model.EchoBackend(answer))
    get = lambda path, kind: F.try_variant_get("answer", path, kind)
    return found.select("n_name", get("$.name.first", "string").alias("first"), get("$.size", "bigint").alias("size"), get("$.error", "string").alias("error"), get("$.raw", "string").alias("raw"))


QUERIES = {
    "session_references": (references_in_sessions, f"""
WITH {ITEMS_SQL}, o AS (SELECT session_id, item_id, min(event_id) AS first, max(event_id) AS last FROM actor_events WHERE session_id IS NOT NULL AND item_id IS NOT NULL AND event_id IS NOT NULL GROUP BY ALL),
s AS (SELECT session_id, list(item_id ORDER BY first, item_id)[1:5] AS listed, arg_max(item_id, last) AS last_item FROM o GROUP BY session_id),
r AS (SELECT session_id, last_item, CASE WHEN n = 7 THEN [] ELSE listed END AS listed, n, CASE n WHEN 0 THEN '' WHEN 1 THEN 'the first one' WHEN 2 THEN 'show me the SECOND' WHEN 3 THEN '3rd please' WHEN 4 THEN 'last' WHEN 5 THEN 'no such thing' WHEN 6 THEN 'item ' || upper(last_item) ELSE lower(last_item) END AS ref FROM s, range(8) t(n)),
k AS (SELECT *, lower(trim(ref)) AS t FROM r),
c AS (SELECT *, CASE WHEN ref = '' THEN last_item WHEN contains(t, 'first') AND len(listed) >= 1 THEN listed[1] WHEN contains(t, 'second') AND len(listed) >= 2 THEN listed[2] WHEN contains(t, '3rd') AND len(listed) >= 3 THEN listed[3] WHEN contains(t, 'last') AND len(listed) >= 1 THEN listed[-1] END AS a,
  list_filter(listed, lambda i: contains(t, lower(left(i, 6))))[1] AS b,
  (SELECT arg_min(id, (lower(label) <> t, id)) FROM i WHERE contains(lower(label), t)) AS l, (SELECT min(id) FROM i WHERE lower(id) = t) AS e FROM k)
SELECT session_id || '/' || n AS ref_id, CASE WHEN ref = '' THEN a ELSE coalesce(a, b, l, e) END AS id, CASE WHEN ref = '' THEN 'last' WHEN a IS NOT NULL THEN 'ordinal' WHEN b IS NOT NULL THEN 'short id'
  WHEN l IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM i WHERE lower(label) = t) THEN 'label' ELSE 'part' END WHEN e IS NOT NULL THEN 'candidate' ELSE 'none' END AS rule FROM c"""),
    "choice_search": (choice_search, """
WITH f AS (SELECT DISTINCT id FROM workflow_items WHERE contains(lower(concat_ws(' ', label, description)), 'voice') AND id IN (SELECT id FROM workflow_items WHERE status.branch = 'default') ORDER BY id LIMIT 10)
SELECT id, row_number() OVER (ORDER BY id) AS place, CASE WHEN count(*) OVER () = 1 THEN 'one' ELSE 'many' END AS outcome FROM f"""),
    "local_edits": (local_edits, """
WITH b AS (SELECT DISTINCT id, json_extract_string(metadata, '$.topic') AS topic, json_extract_string(metadata, '$.origin') AS origin, json_exists(metadata, '$.topic') AS ht, json_exists(metadata, '$.origin') AS ho FROM base_ideas WHERE id IS NOT NULL AND json_valid(metadata)),
m(message, field, kind, value) AS (VALUES ('replace the topic: red barn', 'topic', 'replace', 'red barn'), ('fix the origin', 'origin', 'replace', NULL), ('shorten it: x', NULL, NULL, NULL), ('delete the topic', 'topic', NULL, NULL), ('edit the colour: blue', 'colour', 'replace', 'blue'), ('rewrite origin: desk: two', 'origin', 'replace', 'desk: two')),
e AS (SELECT *, CASE WHEN field IS NULL THEN 'no field' WHEN field = 'colour' OR (field = 'topic' AND NOT ht) OR (field = 'origin' AND NOT ho) THEN 'missing field' WHEN kind IS NULL THEN 'no transformation' WHEN value IS NULL THEN 'no value' END AS error FROM b, m)
SELECT id, message, field, kind, value, error, CASE WHEN error IS NULL AND field = 'topic' THEN value ELSE topic END AS topic, CASE WHEN error IS NULL AND field = 'origin' THEN value ELSE origin END AS origin FROM e"""),
    "coarse_to_fine_groups": (coarse_fine_groups, """
WITH g(label, group_name) AS (VALUES ('click', 'attention'), ('view', 'attention'), ('purchase', 'money'), ('signup', 'money')),
d AS (SELECT epoch_us(ts) AS us, group_name, value AS score FROM events JOIN g ON event_type = label WHERE ts IS NOT NULL),
k AS (SELECT us // 3600000000 AS h FROM d WHERE group_name = 'attention' GROUP BY 1 HAVING max(score) >= 400)
SELECT us // 60000000 * 60 AS window_start, group_name, max(score) AS score, count(*) AS n FROM d WHERE us // 3600000000 IN (FROM k) GROUP BY ALL"""),
    "strong_frames": (strong_frames, "SELECT event_id AS idx, event_type AS label, value AS score, round(event_id * 3600.0 / 1000, 6) AS start, round(event_id * 3600.0 / 1000 + 0.975, 6) AS \"end\" FROM events WHERE regexp_matches(lower(event_type), 'click|error') AND value > 150"),
    "sample_windows": (windows_of_samples, """
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(0, greatest(len(embedding) - 16, 0), 8)) AS s FROM embeddings)
SELECT vec_id, s / 16.0::DOUBLE AS start, (s + 16) / 16.0::DOUBLE AS "end", round(list_sum(e[s + 1 : s + 16]), 6) AS total FROM s"""),
    "clip_samples": (clips_of_samples, """
WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS e, 100 + label * 130 AS a FROM embeddings), p AS (SELECT *, floor(a * 16 / 1000.0)::INT AS x, floor((a + 1500) * 16 / 1000.0)::INT AS y FROM c)
SELECT vec_id, 'clip_' || a || '_' || (a + 1500) || '.wav' AS file, len(e[x + 1 : y])::BIGINT AS n, round(coalesce(list_sum(e[x + 1 : y]), 0), 6) AS total FROM p"""),
    "turn_decision_rows": (turn_decision_rows, """
WITH t AS (SELECT DISTINCT snapshot_no, decisions AS j FROM turn_snapshots WHERE decisions IS NOT NULL AND json_valid(decisions)), b AS (SELECT snapshot_no, j, unnest(json_keys(j)) AS bucket FROM t WHERE json_type(j) = 'OBJECT'),
l AS (SELECT snapshot_no, bucket, json_extract(j, '$."' || bucket || '"')::JSON[] AS ds FROM b), d AS (SELECT snapshot_no, bucket, unnest(ds) AS d, generate_subscripts(ds, 1) - 1 AS place FROM l)
SELECT snapshot_no, bucket, place, json_extract_string(d, '$.decision_id') AS decision_id, json_extract_string(d, '$.idea.key') AS key, json_extract_string(d, '$.rationale') AS rationale, coalesce(json_extract_string(d, '$.status'), bucket) AS status FROM d"""),
    "status_round_trip": (status_round_trip, "SELECT DISTINCT id, status.branch AS branch, status.substate AS substate, status.approved AS approved, status.requires_approval AS requires_approval, status.flags AS flags FROM workflow_items"),
    "next_actions": (next_actions, "SELECT DISTINCT id, status.branch AS branch, status.substate AS substate, coalesce(status.requires_approval AND NOT coalesce(status.approved, false), false) AS needs_approval, status IS NOT NULL AND NOT coalesce(status.requires_approval AND NOT coalesce(status.approved, false), false) AS ready FROM workflow_items"),
    "idea_record_rows": (idea_record_rows, """
WITH s AS (SELECT id, count(*) AS small_records FROM (SELECT DISTINCT id, description, approved FROM base_ideas) GROUP BY id), f AS (SELECT DISTINCT id, description, approved, idea_type, style, metadata, created_at, updated_at, exported_at FROM base_ideas)
SELECT id, idea_type AS type, approved, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, strftime(exported_at, '%Y-%m-%dT%H:%M:%S.%f') AS exported_at, small_records FROM f JOIN s USING (id)"""),
    "node_shapes": (node_shapes, """
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN printf('<rect x="%.2f" y="%.2f" width="8.00" height="8.00" fill="rgb(1,2,3)"/>', n_nationkey * 10.5 - 4, n_regionkey * 20.25 - 4)
  ELSE printf('<circle cx="%.2f" cy="%.2f" r="4.00" stroke="black" stroke-width="2.0" fill="none"/>', n_nationkey * 10.5, n_regionkey * 20.25) END AS shape,
  printf('<text x="%.2f" y="%.2f" font-size="12" text-anchor="start">', n_nationkey * 10.5, n_regionkey * 20.25) || '&lt;' || n_name || '&gt; &amp; co</text>' AS label FROM nation"""),
    "model_fields": (model_fields, "SELECT DISTINCT prompt, CASE length(prompt) % 4 WHEN 1 THEN 'topic' WHEN 2 THEN 'origin' END AS field, CASE WHEN prompt IS NULL OR length(prompt) % 4 = 0 THEN 'no field' WHEN length(prompt) % 4 = 3 THEN 'unknown field' END AS reason FROM eval_traces"),
    "model_checks": (model_checks, "SELECT p_partkey, p_partkey % 3 = 0 OR length(coalesce(p_name, '')) % 2 = 0 AS valid FROM part"),
    "model_intents": (model_intents, "SELECT DISTINCT prompt, CASE length(prompt) % 4 WHEN 0 THEN 'list_items' WHEN 1 THEN 'describe_workflow' ELSE 'idle' END AS intent FROM eval_traces"),
    "model_parameters": (model_found_parameters, "SELECT DISTINCT prompt, length(prompt)::VARCHAR AS size, CASE WHEN length(prompt) % 2 = 0 THEN 'cut' END AS step, (CASE WHEN prompt IS NULL THEN 0 ELSE 2 - length(prompt) % 2 END)::BIGINT AS n FROM eval_traces"),
    "item_records": (item_records, "SELECT DISTINCT id, item_type AS kind, status.branch AS branch, status.approved::VARCHAR AS approved, strftime(exported_at, '%Y-%m-%dT%H:%M:%S.%f') AS exported_at, label AS summary FROM workflow_items"),
    "trace_documents": (trace_documents, "SELECT DISTINCT trace_id, true AS same, true AS unanswered FROM eval_traces"),
    "intent_contexts": (intent_contexts, """
SELECT n.n_nationkey AS id, 'regions' AS context_key, r_name AS names, 1::BIGINT AS fields FROM nation n JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 = 0
UNION ALL SELECT n.n_nationkey, 'nation', string_agg(o.n_name, '|' ORDER BY o.n_nationkey), 2 FROM nation n JOIN nation o ON o.n_regionkey = n.n_regionkey WHERE n.n_nationkey % 3 < 2 GROUP BY 1"""),
    "wav_clips": (wav_clips, """
WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x * 32767) / 32768.0::DOUBLE) AS e, unnest(range(0, (len(embedding) + 15) // 16)) AS chunk FROM embeddings)
SELECT vec_id, chunk, len(e[chunk * 16 + 1 : chunk * 16 + 16])::BIGINT AS n, round(list_sum(e[chunk * 16 + 1 : chunk * 16 + 16]), 2) + 0.0 AS total FROM s"""),
    "typed_answers": (typed_answers, "SELECT DISTINCT id, approved, NULL::BIGINT AS flag_exact, approved::INT::BIGINT AS flag_any, length(id)::BIGINT AS n_exact, length(id)::BIGINT AS n_any, NULL::BIGINT AS s_exact, NULL::BIGINT AS s_any FROM base_ideas WHERE id IS NOT NULL"),
    "steps_before": (steps_before, "WITH r AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation) SELECT n_regionkey AS region, coalesce(string_agg(n_name, '|' ORDER BY n_name) FILTER (r < 3), '') AS steps FROM r GROUP BY 1"),
    "rows_not_in": (orders_not_in, "SELECT o_custkey, o_orderpriority FROM orders f WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'O' AND o.o_custkey IS NOT DISTINCT FROM f.o_custkey AND o.o_orderpriority IS NOT DISTINCT FROM f.o_orderpriority)"),
    "shared_tokens": (label_tokens, "SELECT DISTINCT trace_id, coalesce(array_to_string(list_sort(list_distinct(list_intersect(regexp_extract_all(lower(prompt), '[a-z]+'), regexp_extract_all(lower(agent_response), '[a-z]+')))), ' '), '') AS shared FROM (SELECT DISTINCT trace_id, prompt, agent_response FROM eval_traces WHERE prompt IS NOT NULL AND agent_response IS NOT NULL)"),
    "rendered_messages": (rendered_messages, """
SELECT DISTINCT trace_id, array_to_string(list_filter([nullif(concat_ws(' ', CASE WHEN len(errors) > 0 THEN '!' END, CASE WHEN case_name IS NOT NULL THEN '**' || case_name || '**' END), ''), nullif(prompt, ''),
  nullif(array_to_string(list_transform(errors, lambda b: '- ' || b), chr(10)), ''), nullif(item_resolution.resolution_msg, '')], lambda p: p IS NOT NULL), chr(10) || chr(10)) AS message FROM eval_traces"""),
    "css_colors": (part_colors, "SELECT DISTINCT p_size, CASE p_size % 3 WHEN 1 THEN printf('rgb(%d,%d,%d)', p_size, p_size * 3 % 256, p_size * 7 % 256) WHEN 2 THEN printf('rgba(%d,%d,%d,%.3f)', p_size, p_size * 3 % 256, p_size * 7 % 256, p_size * 5 / 255.0) END AS color FROM part"),
    "block_layout_framed": (block_layout_framed, """
WITH t AS (SELECT *, sum(l_quantity + 12) OVER w AS total, 12.0 * count(*) OVER w AS gaps FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
z AS (SELECT l_orderkey, l_linenumber, l_quantity + 12.0 * CASE WHEN total > 150 THEN greatest(0.0, 1 - (total - 150) / gaps) ELSE 1.0 END AS size FROM t)
SELECT l_orderkey, l_linenumber, round(sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - size, 6) AS top, round(sum(size) OVER (PARTITION BY l_orderkey), 6) AS total_height FROM z"""),
    "model_answers": (model_answers, "SELECT item_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) % 2 = 0 THEN length(text)::VARCHAR ELSE 'about ' || length(text) END AS answer, CASE WHEN length(text) % 2 = 1 THEN 'invalid_json' END AS error FROM eval_items"),
    "model_edits": (model_edits, "SELECT DISTINCT label, upper(label) AS edited FROM workflow_items"),
    "model_extracts": (model_extracts, "SELECT DISTINCT item_type, item_type[1] AS letter, NULL::VARCHAR AS colour, NULL::VARCHAR AS error FROM workflow_items"),
    "model_descriptions": (model_descriptions, "SELECT DISTINCT idea_type, list_aggregate(list_transform(string_split(idea_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '_') AS title, left(idea_type, 3) AS summary_short, NULL::VARCHAR AS summary_long, NULL::VARCHAR AS source_url FROM base_ideas"),
    "model_grades": (model_grades, "SELECT item_id, 'true' AS ok FROM eval_items WHERE length(text) < 60"),
    "model_rewrites": (model_rewrites, "SELECT DISTINCT doc_kind, reverse(doc_kind) AS turned, CASE WHEN doc_kind IS NOT NULL THEN 'invalid_json' END AS error FROM documents"),
    "model_summaries": (model_summaries, "SELECT idea_type, coalesce(sum(length(description)), 0)::BIGINT AS chars FROM base_ideas GROUP BY idea_type"),
    "model_lists": (model_lists, "SELECT n_nationkey, i AS place, n_name[i] AS value FROM nation, range(1, 4) t(i)"),
    "model_pairs": (model_pairs, "SELECT a.n_name, b.n_name AS other, (a.n_name[1] = b.n_name[1])::VARCHAR AS is_same, (length(a.n_name) > length(b.n_name))::VARCHAR AS is_broad FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name"),
    "model_metadata": (model_metadata, "SELECT n_name, CASE WHEN n_name[1] > 'F' THEN n_name[1] END AS first, CASE WHEN n_name[1] > 'F' THEN length(n_name) END AS size, CASE WHEN n_name[1] <= 'F' THEN 'invalid_json' END AS error, CASE WHEN n_name[1] <= 'F' THEN n_name END AS raw FROM nation"),
}
