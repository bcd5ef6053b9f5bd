"""Queries on ideas, decisions, turns and items, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions.text import run_label, stripped, title_case
from inkweave.operators.keyed import keep_first, keep_last, key_changes, not_in, upsert, value_changes
from inkweave.plans.turn import Turn, TurnEngine, accumulate, traced
from inkweave.session import table


def _status():
    return F.lower(F.trim("status")).alias("status")


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _past(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "decisions").select(F.col("idea.key").alias("key"), _status())


def _turn(spark: SparkSession, sf_dir: str) -> Turn:
    corpus = table(spark, sf_dir, "base_ideas").select(F.col("id").alias("key"), "description", "idea_type", "approved", _micros("updated_at").alias("updated"))
    engine = TurnEngine(
        strategies={"approved": lambda c: c.where("approved"), "typed": lambda c: c.where("idea_type is not null"), "all": lambda c: c},
        criteria={"long_enough": lambda: F.coalesce(F.char_length("description") >= 120, F.lit(False)), "typed": lambda: F.col("idea_type").isNotNull(), "approved": lambda: F.coalesce("approved", F.lit(False))},
        order=("updated", "description", "idea_type", "approved"),
    )
    return engine.run(corpus, _past(spark, sf_dir))


#: Ideas in the order of strategies, keep-first, anti-filter, criteria and policy.
TURN_SQL = """
WITH u AS (
  SELECT id AS key, description, idea_type, approved, epoch_us(updated_at) AS updated, s.ord AS ord, s.name AS strategy
  FROM base_ideas, (VALUES (0, 'approved'), (1, 'typed'), (2, 'all')) s(ord, name)
  WHERE id IS NOT NULL AND (s.ord = 2 OR (s.ord = 0 AND approved) OR (s.ord = 1 AND idea_type IS NOT NULL))),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord, updated NULLS FIRST, description NULLS FIRST, idea_type NULLS FIRST, approved NULLS FIRST) = 1),
j AS (
  SELECT key, strategy, coalesce(length(description) >= 120, false) AS long_enough, idea_type IS NOT NULL AS typed, coalesce(approved, false) AS approved
  FROM f WHERE NOT EXISTS (SELECT 1 FROM decisions d WHERE d.idea.key = f.key AND lower(trim(d.status)) = 'accepted')),
d AS (SELECT *, CASE long_enough::int + typed::int + approved::int WHEN 3 THEN 'accepted' WHEN 0 THEN 'rejected' ELSE 'deferred' END AS status FROM j)
"""


def turn_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ideas of each strategy a turn accepts, rejects and defers."""
    return _turn(spark, sf_dir).decisions.groupBy("strategy", "status").agg(F.count("*").alias("n"))


def turn_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each idea of the turn with its status."""
    return _turn(spark, sf_dir).decisions.select("key", "strategy", "status")


def turn_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criteria matrix in long form."""
    return _turn(spark, sf_dir).criteria


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version of each idea."""
    rows = table(spark, sf_dir, "base_ideas").withColumn("updated", _micros("updated_at"))
    return keep_first(rows.where("id is not null"), ["id"], "updated", "approved").select("id", "updated", "approved")


def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last received row of each decision."""
    rows = table(spark, sf_dir, "decisions").select("decision_id", _micros("received_at").alias("received"), _status())
    return keep_last(rows, ["decision_id"], "received", "status")


def accumulated_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored decisions (received early) with a turn's (received late): of several for a key in a bucket the last counts."""
    rows = table(spark, sf_dir, "decisions").select(F.col("idea.key").alias("key"), _status(), _micros("received_at").alias("ord")).where("key is not null")
    middle = F.lit(1_930_000_000_000_000)
    return accumulate(rows.where(F.col("ord") < middle), rows.where(F.col("ord") >= middle))


def filter_past_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas that no accepted decision suppresses."""
    ideas = table(spark, sf_dir, "base_ideas").select(F.col("id").alias("key")).where("key is not null").distinct()
    return not_in(ideas, _past(spark, sf_dir).where("status = 'accepted'"), "key")


def turn_diff_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idea keys that only accepted or only rejected decisions have."""
    past = _past(spark, sf_dir).where("key is not null")
    return key_changes(past.where("status = 'rejected'"), past.where("status = 'accepted'"), "key")


def turn_diff_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose numbers of decisions differ between statuses."""
    past = _past(spark, sf_dir).where("key is not null")
    count = lambda s: past.where(F.col("status") == s).groupBy("key").agg(F.count("*").alias("n"))
    return value_changes(count("rejected"), count("accepted"), "key", "n")


def decision_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision with the deliveries of its turn."""
    turns = table(spark, sf_dir, "turn_snapshots").select(F.lower(stripped("turn_id")).alias("turn_id"), "snapshot_no").distinct()
    turns = turns.groupBy("turn_id").agg(F.count("*").alias("deliveries"), F.max("snapshot_no").alias("last_snapshot"))
    decisions = table(spark, sf_dir, "decisions").select("decision_id", F.lower(stripped("turn_id")).alias("turn_id")).distinct()
    return traced(decisions, turns)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by status, whatever its spelling."""
    return table(spark, sf_dir, "decisions").select("decision_id", _status()).distinct().groupBy("status").agg(F.count("*").alias("n"))


def fresh_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas that aren't approved and were updated within two days of their creation."""
    age = F.abs(_micros("updated_at") - _micros("created_at"))
    return table(spark, sf_dir, "base_ideas").where(~F.coalesce("approved", F.lit(False)) & (age <= 172_800_000_000)).select("id", age.alias("age_us")).distinct()


def idea_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas by type: how many, approved, exported, and their mean length."""
    rows = keep_last(table(spark, sf_dir, "base_ideas").withColumn("u", _micros("updated_at")), ["id"], "u", "approved", "exported_at")
    return rows.groupBy("idea_type").agg(
        F.count("*").alias("n"), F.count_if("approved").alias("approved"), F.count("exported_at").alias("exported"), F.round(F.avg(F.char_length("description")), 4).alias("mean_chars")
    )


def unexported_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved ideas that no exported version has."""
    ideas = table(spark, sf_dir, "base_ideas")
    return ideas.where("approved").select("id").distinct().join(ideas.where("exported_at is not null").select("id").distinct(), "id", "left_anti")


def upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after an update made of orders: known keys are merged, null values win, others are appended."""
    fields = lambda **c: F.map_from_arrays(F.array(*map(F.lit, c)), F.array(*c.values()))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fields(name=F.col("c_name"), segment=F.col("c_mktsegment")).alias("fields"), F.col("c_custkey").alias("ord"))
    new = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 2).alias("id"), fields(segment=F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")), status=F.col("o_orderstatus")).alias("fields"), F.col("o_orderkey").alias("ord")
    )
    done = upsert(old, new, "id", "fields", "ord")
    value = lambda k: F.col("fields")[k].alias(k)
    return done.select("id", value("name"), value("segment"), value("status"), F.size("fields").cast("long").alias("n_fields"), F.col("is_new").cast("long").alias("is_new"), "ord")


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each item that is on the default branch, approved and not exported."""
    rows = table(spark, sf_dir, "workflow_items").withColumn("u", _micros("updated_at"))
    last = keep_last(rows, ["id"], "u")
    return last.where((F.col("status.branch") == "default") & F.col("status.approved") & F.col("exported_at").isNull()).select("id", F.col("status.substate").alias("substate"), "u")


def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their label, or one made of the time and the id, and their type for people."""
    rows = table(spark, sf_dir, "workflow_items").select("id", F.coalesce("label", run_label("created_at", "id")).alias("label"), title_case("item_type").alias("kind"))
    return rows.where("id is not null").distinct()


def steps_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have an output of each step."""
    steps = table(spark, sf_dir, "workflow_items").select(F.explode(F.json_object_keys("step_outputs")).alias("step"))
    return steps.groupBy("step").agg(F.count("*").alias("n"))


QUERIES = {
    "turn_decisions": (turn_decisions, TURN_SQL + "SELECT strategy, status, count(*) AS n FROM d GROUP BY ALL"),
    "turn_ideas": (turn_ideas, TURN_SQL + "SELECT key, strategy, status FROM d"),
    "turn_criteria": (turn_criteria, TURN_SQL + "SELECT key, 'long_enough' AS criterion, long_enough AS passed FROM d UNION ALL SELECT key, 'typed', typed FROM d UNION ALL SELECT key, 'approved', approved FROM d"),
    "dedupe_first": (dedupe_first, "SELECT id, epoch_us(updated_at) AS updated, approved FROM base_ideas WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at NULLS FIRST, approved NULLS FIRST) = 1"),
    "dedupe_last": (dedupe_last, "SELECT decision_id, epoch_us(received_at) AS received, lower(trim(status)) AS status FROM decisions QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY received_at DESC NULLS LAST, lower(trim(status)) DESC NULLS LAST) = 1"),
    "accumulated_decisions": (accumulated_decisions, "SELECT idea.key AS key, lower(trim(status)) AS status, max(epoch_us(received_at)) AS ord FROM decisions WHERE idea.key IS NOT NULL AND received_at IS NOT NULL GROUP BY ALL"),
    "filter_past_accepted": (filter_past_accepted, "SELECT DISTINCT id AS key FROM base_ideas b WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.idea.key = b.id AND lower(trim(d.status)) = 'accepted')"),
    "turn_diff_ideas": (turn_diff_ideas, """
WITH p AS (SELECT DISTINCT idea.key AS key, lower(trim(status)) AS status FROM decisions WHERE idea.key IS NOT NULL),
a AS (SELECT key FROM p WHERE status = 'rejected'), b AS (SELECT key FROM p WHERE status = 'accepted')
SELECT key, 'added' AS change FROM b WHERE key NOT IN (FROM a) UNION ALL SELECT key, 'removed' FROM a WHERE key NOT IN (FROM b)"""),
    "turn_diff_criteria": (turn_diff_criteria, """
WITH p AS (SELECT idea.key AS key, lower(trim(status)) AS status, count(*) AS n FROM decisions WHERE idea.key IS NOT NULL GROUP BY ALL)
SELECT coalesce(a.key, b.key) AS key, a.n AS was, b.n AS now FROM (FROM p WHERE status = 'rejected') a FULL JOIN (FROM p WHERE status = 'accepted') b ON a.key = b.key WHERE a.n IS DISTINCT FROM b.n"""),
    "decision_lookup": (decision_lookup, r"""
WITH t AS (SELECT lower(regexp_replace(turn_id, '^\s+|\s+$', '', 'g')) AS turn_id, count(DISTINCT snapshot_no) AS deliveries, max(snapshot_no) AS last_snapshot FROM turn_snapshots GROUP BY 1),
d AS (SELECT DISTINCT decision_id, lower(regexp_replace(turn_id, '^\s+|\s+$', '', 'g')) AS turn_id FROM decisions)
SELECT turn_id, decision_id, deliveries, last_snapshot FROM d JOIN t USING (turn_id)"""),
    "status_counts": (status_counts, "SELECT status, count(*) AS n FROM (SELECT DISTINCT decision_id, lower(trim(status)) AS status FROM decisions) GROUP BY ALL"),
    "fresh_ideas": (fresh_ideas, "SELECT DISTINCT id, abs(epoch_us(updated_at) - epoch_us(created_at)) AS age_us FROM base_ideas WHERE NOT coalesce(approved, false) AND abs(epoch_us(updated_at) - epoch_us(created_at)) <= 172800000000"),
    "idea_summaries": (idea_summaries, """
WITH l AS (FROM base_ideas QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, approved DESC NULLS LAST, exported_at DESC NULLS LAST) = 1)
SELECT idea_type, count(*) AS n, count(*) FILTER (approved) AS approved, count(exported_at) AS exported, round(avg(length(description)), 4) AS mean_chars FROM l GROUP BY ALL"""),
    "unexported_ideas": (unexported_ideas, "SELECT DISTINCT id FROM base_ideas b WHERE approved AND NOT EXISTS (SELECT 1 FROM base_ideas c WHERE c.id = b.id AND c.exported_at IS NOT NULL)"),
    "upsert_records": (upsert_records, """
WITH n AS (SELECT o_custkey * 2 AS id, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS segment, o_orderstatus AS status, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders)
SELECT coalesce(c_custkey, id) AS id, c_name AS name, CASE WHEN id IS NOT NULL THEN segment ELSE c_mktsegment END AS segment, status,
  CASE WHEN c_custkey IS NULL THEN 2 WHEN id IS NULL THEN 2 ELSE 3 END::BIGINT AS n_fields, (c_custkey IS NULL)::BIGINT AS is_new, coalesce(c_custkey, first_key) AS ord
FROM customer FULL JOIN (FROM n WHERE r = 1) n ON c_custkey = id"""),
    "list_items": (list_items, """
WITH l AS (FROM workflow_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)
SELECT id, status.substate AS substate, epoch_us(updated_at) AS u FROM l WHERE status.branch = 'default' AND status.approved AND exported_at IS NULL"""),
    "item_labels": (item_labels, """
SELECT DISTINCT id, coalesce(label, strftime(created_at, 'Run %b %d %Y %I:%M %p') || ' (' || left(id, 6) || ')') AS label,
  list_aggregate(list_transform(string_split(replace(item_type, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS kind FROM workflow_items WHERE id IS NOT NULL"""),
    "steps_of_items": (steps_of_items, "SELECT step, count(*) AS n FROM (SELECT unnest(json_keys(step_outputs)) AS step FROM workflow_items WHERE json_valid(step_outputs)) GROUP BY ALL"),
}
