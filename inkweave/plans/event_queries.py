"""Queries on the event log, traces, detections and item trees, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.functions.geometry import axis, nice_number, on_circle, scaled_threshold
from inkweave.operators.detections import coarse_to_fine, group_windows
from inkweave.operators.forest import arcs, children, first_matching, flatten_nodes, placed, segment_ranges
from inkweave.operators.keyed import keep_last, top_per_key
from inkweave.operators.sequences import chunks, drop_repeats, islands, merged_runs, successors, transitions
from inkweave.plans.events import case_score, next_run, recent_actions, resolved, scored_candidates, unknown_references
from inkweave.plans.intents import missing_parameters, parsed
from inkweave.session import table
from inkweave.streaming.events import event_stream, run_once, window_counts


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each actor event once: its first recorded row."""
    rows = table(spark, sf_dir, "actor_events").select("event_id", _micros("ts").alias("at_us"), "actor_id", "workflow_name", "item_id", "event_type")
    return rows.groupBy("event_id").agg(F.min(F.struct("at_us", "actor_id", "workflow_name", "item_id", "event_type")).alias("e")).select("event_id", "e.*")


#: The same rows in SQL (nulls come first in Spark's structs).
EVENTS_SQL = """WITH e AS (SELECT event_id, epoch_us(ts) AS at_us, actor_id, workflow_name, item_id, event_type FROM actor_events
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts NULLS FIRST, actor_id NULLS FIRST, workflow_name NULLS FIRST, item_id NULLS FIRST, event_type NULLS FIRST) = 1) """


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty latest chat events since a time."""
    events = table(spark, sf_dir, "actor_events").dropDuplicates(["event_id"])
    return recent_actions(events, 50, since="2031-01-20 00:00:00", event_type="chat").select("event_id", _micros("ts").alias("at_us"))


def recent_per_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest events of each actor; a group limit before the shuffle bounds what a hot actor sends."""
    rows = _events(spark, sf_dir).where("at_us is not null")
    return top_per_key(rows, ["actor_id"], 3, F.desc("at_us"), F.desc("event_id")).select("actor_id", "event_id", F.col("rank").cast("long").alias("rank"))


def actor_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each actor and type, pre-aggregated before the shuffle, so a hot actor is no hot task."""
    return _events(spark, sf_dir).groupBy("actor_id", "event_type").agg(F.count("*").alias("n"), F.min("at_us").alias("first_at"), F.max("at_us").alias("last_at"))


def step_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an item of another type than the one before."""
    rows = _events(spark, sf_dir).where("item_id is not null and at_us is not null")
    return transitions(rows, ["item_id"], ["at_us", "event_id"], "event_type").select("item_id", "event_id", "was", F.col("event_type").alias("now"))


def consecutive_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user without those of the same type as the one before."""
    return drop_repeats(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


def activity_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours in a row in which a workflow has events."""
    hours = _events(spark, sf_dir).where("at_us is not null").select("workflow_name", F.floor(F.col("at_us") / 3_600_000_000).cast("long").alias("hour")).distinct()
    runs = islands(hours, ["workflow_name"], "hour").groupBy("workflow_name", F.col("island").cast("long").alias("island"))
    return runs.agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count("*").alias("hours"))


def progress_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of an item of one type as one row, their details merged."""
    rows = _events(spark, sf_dir).where("item_id is not null and at_us is not null")
    rows = rows.withColumn("ord", F.struct("at_us", "event_id")).withColumn("details", F.create_map(F.lit("actor"), F.col("actor_id"), F.lit("workflow"), F.col("workflow_name")))
    return merged_runs(rows, ["item_id"], "ord", ["event_type"], "details").select("item_id", F.col("run").cast("long").alias("run"), "event_type", "rows", F.col("details")["actor"].alias("last_actor"))


def next_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workflow to run next, from its last event and how many it had."""
    rows = _events(spark, sf_dir).where("workflow_name is not null and at_us is not null").groupBy(F.col("workflow_name").alias("name")).agg(F.max("at_us").alias("last_at"), F.count("*").alias("budget_used"))
    records = rows.select(
        "name", F.lit(True).alias("enabled"), F.lit(60).alias("cooldown_seconds"), F.lit(1_000_000_000).alias("budget_per_hour"), "budget_used", (F.lit(1.0) + F.char_length("name")).alias("static_priority"),
        F.lit(1.0).alias("contextual"), F.timestamp_micros("last_at").alias("last_run"), F.col("name").alias("ord"),
    )
    return next_run(records, F.lit("2031-07-01 00:00:00").cast("timestamp")).select("name", F.round("score", 4).alias("score"))


def trace_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean score of each intent's traces: the rule's intent against the final one, an answer that mentions an item, one that says it failed."""
    rows = table(spark, sf_dir, "eval_traces").groupBy("trace_id").agg(F.max("intent_rule_based").alias("ruled"), F.max("final_intent").alias("final"), F.max("agent_response").alias("answer"))
    missing = (~F.coalesce(F.lower("answer").contains("item"), F.lit(False))).cast("int")
    forbidden = F.coalesce(F.lower("answer").contains("blocked"), F.lit(False)).cast("int")
    scored = rows.withColumn("score", case_score(F.col("ruled") != F.col("final"), missing, forbidden))
    return scored.groupBy("final").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.99).alias("passed"), F.round(F.avg("score"), 4).alias("mean_score"))


def message_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intents that the rules find in prompts."""
    prompts = table(spark, sf_dir, "eval_traces").select("trace_id", "prompt").distinct()
    return parsed(prompts, "prompt").groupBy("intent").agg(F.count("*").alias("n"), F.count("step_name").alias("with_step"), F.count("edit_text").alias("with_edit"))


def unknown_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of items that nobody has."""
    return unknown_references(_events(spark, sf_dir), "item_id", table(spark, sf_dir, "workflow_items").where("id is not null"), "id").select("event_id", "item_id")


def missing_intent_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces whose intent lacks what its contract requires."""
    intents = table(spark, sf_dir, "eval_traces").groupBy("trace_id").agg(F.max("final_intent").alias("intent"), F.max("item_resolution.item_id").alias("item_id"), F.max("item_resolution.resolution_msg").alias("msg"))
    intents = intents.select(F.col("trace_id").alias("id"), "intent", F.map_from_arrays(F.array(F.lit("item_id"), F.lit("message")), F.array("item_id", "msg")).alias("parameters"))
    contract = spark.createDataFrame([(i, p, r) for i in ("edit_step_output", "show_step_output", "rewind_substate") for p, r in (("item_id", True), ("message", i != "rewind_substate"))], "intent string, parameter string, required boolean")
    return missing_parameters(intents, contract).select(F.col("id").alias("trace_id"), F.array_join("missing", ",").alias("missing"))


def window_group_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest value of each group of event types in each hour."""
    return group_windows(_detections(spark, sf_dir), _groups(spark), 3_600)


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("start"), F.col("event_type").alias("label"), F.col("value").alias("score"))


def _groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("click", "attention"), ("view", "attention"), ("purchase", "money"), ("signup", "money"), ("signup", "growth")], "label string, group_name string")


def coarse_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes inside the hours in which some group reaches nine tenths of the greatest value."""
    top = table(spark, sf_dir, "events").agg((F.lit(0.9) * F.max("value")).alias("threshold"))
    return coarse_to_fine(_detections(spark, sf_dir), _groups(spark), 3_600, 60, top)


def threshold_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of windows as long as the parts' sizes."""
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    seconds = F.col("p_size").cast("double")
    return sizes.select("p_size", *(F.round(scaled_threshold(F.lit(0.6), seconds, m), 6).alias(m) for m in ("sqrt", "linear", "none")))


def axis_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axis for the orders of each priority."""
    top = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("top"))
    step, end = axis(F.col("top"))
    return top.select("o_orderpriority", F.round(step, 4).alias("step"), F.round(end, 4).alias("axis_end"), F.round(nice_number(F.col("top"), False), 4).alias("nice_top"))


def node_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as clips of their regions: nodes, their numbers, kinds and places on a circle."""
    nation = table(spark, sf_dir, "nation")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    nodes = flatten_nodes(nation.select(F.col("n_regionkey").alias("segment"), place.alias("position"), F.col("n_name").alias("title")))
    ranges = segment_ranges(nodes)
    total = nodes.agg(F.count("*").alias("total"))
    _, x, y = on_circle(F.col("idx"), F.col("total"), 100.0, 100.0, 80.0)
    joined = nodes.join(F.broadcast(total)).join(ranges, "segment")
    return joined.select("segment", "title", "kind", "idx", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), "first_idx", "last_idx")


def node_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arcs between neighbouring nations of a region on a circle."""
    nation = table(spark, sf_dir, "nation")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    nodes = flatten_nodes(nation.select(F.col("n_regionkey").alias("segment"), place.alias("position"), F.col("n_name").alias("title")))
    return arcs(nodes, gap=0.02).select("segment", "idx", F.round("begin_theta", 5).alias("begin_theta"), F.round("end_theta", 5).alias("end_theta"), F.col("large").cast("long").alias("large"))


def resolve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a reference may mean, with their score."""
    return scored_candidates(table(spark, sf_dir, "part"), "12", "p_partkey", "p_name").select("p_partkey", "score")


def reference_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that labels and ids refer to."""
    items = _items(spark, sf_dir).select("id", F.col("label"))
    refs = items.select(F.upper("label").alias("ref")).unionByName(items.select(F.col("id").alias("ref"))).where("ref is not null").distinct()
    return resolved(items, refs).select("ref", "id", F.col("rule").cast("long").alias("rule"))


def reference_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items, labelled with id and label, that the last word of labels and labels without their first and last character refer to."""
    items = _items(spark, sf_dir).where("label is not null")
    parts = items.select(F.upper("label").alias("ref")).unionByName(items.where(F.char_length("label") > 2).selectExpr("substring(label, 2, length(label) - 2) AS ref"))
    return resolved(items.select("id", F.concat_ws(" ", "id", "label").alias("label")), parts.distinct()).select("ref", "id", F.col("rule").cast("long").alias("rule"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "workflow_items").where("id is not null").withColumn("u", _micros("updated_at"))
    return keep_last(rows, ["id"], "u", "parent_id", "label")


#: The latest version of each item.
ITEMS_SQL = """i AS (FROM workflow_items WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, parent_id DESC NULLS LAST, label DESC NULLS LAST) = 1)"""
FOREST_SQL = f"""WITH RECURSIVE {ITEMS_SQL},
p AS (SELECT id, CASE WHEN parent_id IN (SELECT id FROM i) AND parent_id <> id THEN parent_id END AS up FROM i),
t AS (SELECT id, id AS root, 0::BIGINT AS depth, id AS path FROM p WHERE up IS NULL
  UNION ALL SELECT p.id, t.root, t.depth + 1, t.path || '/' || p.id FROM p JOIN t ON p.up = t.id) """


def item_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its root, depth and path."""
    return placed(_items(spark, sf_dir)).select("id", "root", F.col("depth").cast("long").alias("depth"), "path")


def item_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many children each item has."""
    return children(_items(spark, sf_dir))


def blocked_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each root the first item below it, children before parents, that waits for approval."""
    waits = F.col("status.requires_approval") & ~F.coalesce("status.approved", F.lit(False))
    return first_matching(_items(spark, sf_dir), waits).select("root", F.col("first_match").alias("id"), "matches")


def path_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of nations in their regions as paths, with next and previous steps."""
    paths = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("branch")).agg(F.array_sort(F.collect_list("n_name")).alias("steps"))
    return successors(paths).select("branch", F.col("position").cast("long").alias("position"), "step", "next_step", "previous_step")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the number of chunks of 500 characters with 50 of the next one."""
    parts = chunks(F.char_length("text"), 500, 50)
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.size(parts).cast("long").alias("chunks"), F.try_element_at(parts, F.lit(-1))["end"].alias("last_end"))
    return rows.groupBy("chunks").agg(F.count("*").alias("n"), F.max("last_end").alias("last_end"))


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour and type, read as a stream with a watermark."""
    return run_once(window_counts(event_stream(spark, f"{sf_dir}/events.parquet"), ["event_type"]), "complete")


QUERIES = {
    "recent_actions": (recent, "SELECT event_id, epoch_us(ts) AS at_us FROM (SELECT DISTINCT event_id, ts FROM actor_events WHERE event_type = 'chat' AND ts >= TIMESTAMP '2031-01-20') ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "recent_per_actor": (recent_per_actor, EVENTS_SQL + "SELECT actor_id, event_id, row_number() OVER (PARTITION BY actor_id ORDER BY at_us DESC, event_id DESC) AS rank FROM e WHERE at_us IS NOT NULL QUALIFY rank <= 3"),
    "actor_activity": (actor_activity, EVENTS_SQL + "SELECT actor_id, event_type, count(*) AS n, min(at_us) AS first_at, max(at_us) AS last_at FROM e GROUP BY ALL"),
    "step_transitions": (step_transitions, EVENTS_SQL + ", l AS (SELECT *, lag(event_type) OVER (PARTITION BY item_id ORDER BY at_us, event_id) AS was FROM e WHERE item_id IS NOT NULL AND at_us IS NOT NULL) SELECT item_id, event_id, was, event_type AS now FROM l WHERE was IS DISTINCT FROM event_type"),
    "consecutive_dedupe": (consecutive_dedupe, "SELECT user_id, event_id, event_type FROM events WHERE trim(event_type) <> '' QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type"),
    "activity_islands": (activity_islands, EVENTS_SQL + """, h AS (SELECT DISTINCT workflow_name, at_us // 3600000000 AS hour FROM e WHERE at_us IS NOT NULL),
b AS (SELECT *, coalesce((hour - lag(hour) OVER (PARTITION BY workflow_name ORDER BY hour) > 1)::int, 0) AS broken FROM h),
r AS (SELECT workflow_name, hour, sum(broken) OVER (PARTITION BY workflow_name ORDER BY hour)::BIGINT AS island FROM b)
SELECT workflow_name, island, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS hours FROM r GROUP BY ALL"""),
    "progress_runs": (progress_runs, EVENTS_SQL + """, c AS (SELECT *, (lag(event_type) OVER w IS DISTINCT FROM event_type)::int AS new FROM e WHERE item_id IS NOT NULL AND at_us IS NOT NULL WINDOW w AS (PARTITION BY item_id ORDER BY at_us, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY at_us, event_id)::BIGINT AS run FROM c)
SELECT item_id, run, event_type, count(*) AS rows, last(actor_id ORDER BY at_us, event_id) AS last_actor FROM r GROUP BY ALL"""),
    "next_workflow": (next_workflow, EVENTS_SQL + ", r AS (SELECT workflow_name AS name, max(at_us) AS last_at FROM e WHERE workflow_name IS NOT NULL AND at_us IS NOT NULL GROUP BY ALL) SELECT name, round((1.0 + length(name)) * greatest((epoch_us(TIMESTAMP '2031-07-01') - last_at) / 1e6 / 3600, 0.01), 4) AS score FROM r ORDER BY score DESC, name LIMIT 1"),
    "trace_scores": (trace_scores, """
WITH t AS (SELECT trace_id, max(intent_rule_based) AS ruled, max(final_intent) AS final, max(agent_response) AS answer FROM eval_traces GROUP BY ALL),
s AS (SELECT final, greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.4::DOUBLE * coalesce(ruled <> final, true)::int - 0.2::DOUBLE * (NOT coalesce(contains(lower(answer), 'item'), false))::int - 0.2::DOUBLE * coalesce(contains(lower(answer), 'blocked'), false)::int) AS score FROM t)
SELECT final, count(*) AS n, count(*) FILTER (score >= 0.99) AS passed, round(avg(score), 4) AS mean_score FROM s GROUP BY ALL"""),
    "message_intents": (message_intents, r"""
WITH p AS (SELECT DISTINCT trace_id, prompt, lower(regexp_replace(prompt, '^\s+|\s+$', '', 'g')) AS t FROM eval_traces)
SELECT CASE WHEN t LIKE 'show step%' THEN 'show_step_output' WHEN contains(t, 'list') AND contains(t, 'step') AND contains(t, 'output') THEN 'list_step_outputs' WHEN t LIKE 'edit step%' THEN 'edit_step_output'
  WHEN t LIKE 'show schema%' THEN 'show_schema' WHEN t LIKE 'explain schema%' THEN 'explain_schema' WHEN contains(t, 'list') AND contains(t, 'items') THEN 'query_workflow'
  WHEN contains(t, 'describe') AND contains(t, 'workflow') THEN 'describe_workflow' WHEN contains(t, 'list_workflow_items') THEN 'list_workflow_items' WHEN contains(t, 'describe_workflow') THEN 'describe_workflow'
  WHEN contains(t, 'load_recent') THEN 'load_recent' WHEN contains(t, 'show_current_item') THEN 'show_current_item' WHEN contains(t, 'rewind_substate') THEN 'rewind_substate' WHEN contains(t, 'create_item') THEN 'create_item' ELSE 'idle' END AS intent,
  count(*) AS n, count(*) FILTER (len(regexp_split_to_array(regexp_replace(prompt, '^\s+|\s+$', '', 'g'), '\s+')) >= 3) AS with_step, count(*) FILTER (contains(prompt, ':')) AS with_edit FROM p GROUP BY 1"""),
    "unknown_items": (unknown_items, EVENTS_SQL + "SELECT event_id, item_id FROM e WHERE item_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM workflow_items w WHERE w.id = e.item_id)"),
    "missing_intent_parameters": (missing_intent_parameters, """
WITH t AS (SELECT trace_id, max(final_intent) AS intent, coalesce(max(item_resolution.item_id), '') AS item_id, coalesce(max(item_resolution.resolution_msg), '') AS msg FROM eval_traces GROUP BY ALL),
m AS (SELECT trace_id, concat_ws(',', CASE WHEN item_id = '' THEN 'item_id' END, CASE WHEN msg = '' AND intent <> 'rewind_substate' THEN 'message' END) AS missing FROM t WHERE intent IN ('edit_step_output', 'show_step_output', 'rewind_substate'))
FROM m WHERE missing <> ''"""),
    "window_group_max": (window_group_max, """
WITH g(label, group_name) AS (VALUES ('click', 'attention'), ('view', 'attention'), ('purchase', 'money'), ('signup', 'money'))
SELECT epoch_us(ts) // 3600000000 * 3600 AS window_start, group_name, max(value) AS score, count(*) AS n FROM events JOIN g ON label = event_type GROUP BY ALL"""),
    "coarse_to_fine": (coarse_fine, """
WITH g(label, group_name) AS (VALUES ('click', 'attention'), ('view', 'attention'), ('purchase', 'money'), ('signup', 'money')),
d AS (SELECT epoch_us(ts) AS at_us, group_name, value FROM events JOIN g ON label = event_type),
c AS (SELECT DISTINCT at_us // 3600000000 AS h FROM d GROUP BY at_us // 3600000000, group_name HAVING max(value) >= 0.9 * (SELECT max(value) FROM events))
SELECT at_us // 60000000 * 60 AS window_start, group_name, max(value) AS score, count(*) AS n FROM d WHERE at_us // 3600000000 IN (FROM c) GROUP BY ALL"""),
    "threshold_scales": (threshold_scales, "SELECT DISTINCT p_size, round(0.6 / sqrt(p_size::DOUBLE), 6) AS sqrt, round(0.6::DOUBLE / p_size, 6) AS linear, round(0.6::DOUBLE, 6) AS none FROM part"),
    "axis_scale": (axis_scale, """
WITH t AS (SELECT o_orderpriority, max(o_totalprice) AS top FROM orders GROUP BY ALL),
s AS (SELECT *, pow(10.0, floor(log10(top / 5))) AS p, top / 5 / pow(10.0, floor(log10(top / 5))) AS f, pow(10.0, floor(log10(top))) AS q, top / pow(10.0, floor(log10(top))) AS g FROM t),
n AS (SELECT *, CASE WHEN f < 1.5 THEN 1 WHEN f < 3 THEN 2 WHEN f < 7 THEN 5 ELSE 10 END * p AS step, CASE WHEN g <= 1 THEN 1 WHEN g <= 2 THEN 2 WHEN g <= 5 THEN 5 ELSE 10 END * q AS nice FROM s)
SELECT o_orderpriority, round(step, 4) AS step, round(ceil(top / step) * step, 4) AS axis_end, round(nice, 4) AS nice_top FROM n"""),
    "node_layout": (node_layout, """
WITH o AS (SELECT n_regionkey AS segment, n_name AS title, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS idx, count(*) OVER () AS total FROM nation)
SELECT segment, title, CASE WHEN r = 1 THEN 'square' ELSE 'dot' END AS kind, idx, round(100 + 80 * cos(2 * pi() * idx / total - pi() / 2), 4) AS x, round(100 + 80 * sin(2 * pi() * idx / total - pi() / 2), 4) AS y,
  min(idx) OVER (PARTITION BY segment) AS first_idx, max(idx) OVER (PARTITION BY segment) AS last_idx FROM o"""),
    "node_arcs": (node_arcs, """
WITH o AS (SELECT n_regionkey AS segment, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS idx, count(*) OVER () AS total FROM nation),
t AS (SELECT segment, idx, 2 * pi() * idx / total - pi() / 2 AS a, lead(2 * pi() * idx / total - pi() / 2) OVER (PARTITION BY segment ORDER BY idx) AS b FROM o)
SELECT segment, idx, round(a + 0.02, 5) AS begin_theta, round(b - 0.02, 5) AS end_theta, 0::BIGINT AS large FROM t WHERE b IS NOT NULL"""),
    "resolve_candidates": (resolve_candidates, "SELECT p_partkey, CASE WHEN p_partkey = 12 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS score FROM part WHERE p_partkey = 12 OR contains(lower(p_name), '12')"),
    "reference_cascade": (reference_cascade, f"""
WITH {ITEMS_SQL}, l AS (SELECT id, lower(label) AS label FROM i), r AS (SELECT DISTINCT upper(label) AS ref FROM i WHERE label IS NOT NULL UNION SELECT id FROM i),
m AS (SELECT ref, id, CASE WHEN ref = id THEN 1 WHEN lower(ref) = label THEN 2 WHEN label LIKE '% ' || lower(ref) THEN 3 ELSE 4 END AS rule FROM r JOIN l ON ref = id OR contains(label, lower(ref)))
SELECT ref, arg_min(id, (rule, id)) AS id, min(rule)::BIGINT AS rule FROM m GROUP BY ref"""),
    "reference_parts": (reference_parts, f"""
WITH {ITEMS_SQL}, l AS (SELECT id, lower(id || ' ' || label) AS label FROM i WHERE label IS NOT NULL), r AS (SELECT DISTINCT upper(label) AS ref FROM i WHERE label IS NOT NULL UNION SELECT substring(label, 2, length(label) - 2) FROM i WHERE length(label) > 2),
m AS (SELECT ref, id, CASE WHEN ref = id THEN 1 WHEN lower(ref) = label THEN 2 WHEN ends_with(label, ' ' || lower(ref)) THEN 3 ELSE 4 END AS rule FROM r JOIN l ON ref = id OR contains(label, lower(ref)))
SELECT ref, arg_min(id, (rule, id)) AS id, min(rule)::BIGINT AS rule FROM m GROUP BY ref"""),
    "item_forest": (item_forest, FOREST_SQL + "SELECT id, root, depth, path FROM t"),
    "item_children": (item_children, f"WITH {ITEMS_SQL} SELECT id, (SELECT count(*) FROM i c WHERE c.parent_id = i.id) AS children FROM i"),
    "blocked_node": (blocked_node, FOREST_SQL + ", b AS (SELECT t.* FROM t JOIN i USING (id) WHERE i.status.requires_approval AND NOT coalesce(i.status.approved, false)) SELECT root, arg_min(id, path || '/' || chr(1114111)) AS id, count(*) AS matches FROM b GROUP BY root"),
    "path_successor": (path_successor, "SELECT n_regionkey AS branch, row_number() OVER w - 1 AS position, n_name AS step, lead(n_name) OVER w AS next_step, lag(n_name) OVER w AS previous_step FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)"),
    "chunk_counts": (chunk_counts, "SELECT ceil(length(text) / 500)::BIGINT AS chunks, count(*) AS n, max(CASE WHEN length(text) > 0 THEN least(length(text), (ceil(length(text) / 500) - 1) * 500 + 550) END)::BIGINT AS last_end FROM documents WHERE text IS NOT NULL GROUP BY 1"),
    "stream_window_counts": (stream_window_counts, "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL"),
}
