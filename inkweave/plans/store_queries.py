"""Queries that write and read stores and files, in the shared folder, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.plans.idea_queries import TURN_SQL, _micros, _status, _turn
from inkweave.plans.turn import Turn, TurnEngine, turn_diff
from inkweave.session import cut, remove, scratch, table
from inkweave.sources import files
from inkweave.sources.stores import DecisionStore, EventLog, ItemStore, TurnStore

#: Decisions and events after these come later.
LATER = 1_930_000_000_000_000


def _kept(found: DataFrame, path: str) -> DataFrame:
    """A result computed once, so that the folder it came from can go."""
    found = cut(found)
    remove(found.sparkSession, path)
    return found


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "decisions").where("idea.key is not null and received_at is not null")
    return rows.select("decision_id", "turn_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "idea", "rationale", _status(), _micros("received_at").alias("ord"))


def _store(spark: SparkSession, sf_dir: str, turn_id: str | None = None) -> DecisionStore:
    rows, store = _decisions(spark, sf_dir), DecisionStore(spark, scratch(spark, "decisions"))
    store.add(rows.where(F.col("ord") < LATER))
    store.add(rows.where(F.col("ord") >= LATER), turn_id)
    return store


def stored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts in a store of decisions after two batches and a compaction."""
    store = _store(spark, sf_dir)
    store.compact()
    return _kept(store.load().select(F.col("idea.key").alias("key"), "status", "ord"), store.path)


def seeded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many decisions of each status count that were seeded by hand into a store that has others."""
    store = _store(spark, sf_dir, "manual-seed")
    seeded = (F.coalesce("turn_id", F.lit("")) == "manual-seed").alias("seeded")
    return _kept(store.load().groupBy(seeded, "status").agg(F.count("*").alias("n")), store.path)


def stored_turn_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between a stored turn and a later one that has fewer strategies and no past, part by part."""
    corpus = table(spark, sf_dir, "base_ideas").select(F.col("id").alias("key"), "description", "idea_type", "approved", _micros("updated_at").alias("updated"))
    engine = TurnEngine(
        strategies={"typed": lambda c: c.where("idea_type is not null"), "all": lambda c: c},
        criteria={"long_enough": lambda: F.coalesce(F.char_length("description") >= 120, F.lit(False)), "typed": lambda: F.col("idea_type").isNotNull(), "approved": lambda: F.coalesce("approved", F.lit(False))},
        order=("updated", "description", "idea_type", "approved"),
    )
    store = TurnStore(spark, scratch(spark, "turns"))
    for name, turn in (("first", _turn(spark, sf_dir)), ("second", engine.run(corpus))):
        store.save(name, ideas=turn.ideas, criteria=turn.criteria, decisions=turn.decisions)
    first, second = (Turn(**store.load(name)) for name in store.turns())
    parts = turn_diff(first, second)
    row = lambda part, key, change: parts[part].select(F.lit(part).alias("part"), key.alias("key"), change.alias("change"))
    whole = F.concat("key", F.lit(":"), "status")
    return _kept(
        reduce(DataFrame.unionByName, [
            row("ideas", F.col("key"), F.col("change")), row("strategies", F.col("strategy"), F.col("change")), row("criteria", F.col("key"), F.lit("changed")),
            row("decisions_added", whole, F.lit("added")), row("decisions_removed", whole, F.lit("removed")),
        ]), store.path,
    )


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log written in two batches, with its days compacted: how many events each day has."""
    rows = table(spark, sf_dir, "actor_events").select("event_id", "ts", "actor_id")
    log = EventLog(spark, scratch(spark, "events"))
    log.append(rows.where("event_id % 2 = 0").coalesce(1))
    log.append(rows.where("event_id % 2 = 1 or event_id is null").coalesce(1))
    log.rotate()
    return _kept(log.read().groupBy(F.coalesce(F.col("day").cast("string"), F.lit("none")).alias("day")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events")), log.path)


def latest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each item of a store filled in two batches."""
    rows = table(spark, sf_dir, "workflow_items").where("id is not null").select("id", "description", _micros("updated_at").alias("u"))
    path = scratch(spark, "items")
    store = ItemStore(spark, path, "id", "id string, description string, u long", "u")
    half = F.pmod(F.xxhash64("id", "u"), F.lit(2)) == 0
    store.put(rows.where(half))
    store.put(rows.where(~half))
    return _kept(store.get().select("id", "u"), path)


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas written as JSON lines, half of them appended, and read again: by approval how many, and the length of their texts."""
    rows = table(spark, sf_dir, "base_ideas").select("id", "description", "approved")
    path = scratch(spark, "lines")
    files.write_json(rows.where("approved"), path)
    files.append_jsonl(rows.where("not coalesce(approved, false)"), path)
    back = files.read_jsonl(spark, path, "id string, description string, approved boolean")
    return _kept(back.groupBy("approved").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.char_length("description")).alias("chars")), path)


def json_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a JSON file that is read, changed and replaced, twice."""
    folder, schema = scratch(spark, "update"), "k long, name string"
    start = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    files.update_json(spark, f"{folder}/nations", lambda d: d.where("k % 2 = 0"), schema, start)
    done = files.update_json(spark, f"{folder}/nations", lambda d: d.withColumn("name", F.lower("name")).unionByName(start.where("k % 3 = 1")), schema)
    return _kept(done, folder)


def yaml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as YAML documents, a file each, read again."""
    folder = scratch(spark, "yaml")
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").toLocalIterator():
        files.write_yaml(spark, f"{folder}/region_{r.r_regionkey}.yaml", {"name": r.r_name, "keys": [r.r_regionkey, None]})
    found = files.read_yaml(spark, folder)
    return _kept(found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.keys[0]").cast("long").alias("k")), folder)


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations written as lines of text, read as whole files and split again."""
    path = scratch(spark, "text")
    files.write_text(table(spark, sf_dir, "nation").select("n_name"), path)
    return _kept(files.read_text(spark, path).select(F.explode(F.split("text", "\n")).alias("name")).where("name <> ''"), path)


def jsonable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as plain records: times and nested values as text."""
    rows = files.jsonable(table(spark, sf_dir, "workflow_items").select("id", "created_at", "status"))
    return rows.select("id", "created_at", F.get_json_object("status", "$.branch").alias("branch"), F.get_json_object("status", "$.approved").alias("approved")).distinct()


def delivery_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and turns each delivery has."""
    turns = table(spark, sf_dir, "turn_snapshots")
    return turns.groupBy("snapshot_no").agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("turn_id"))).alias("turns"))


_SPLIT = f"""b AS (SELECT idea.key AS key, lower(trim(status)) AS status, epoch_us(received_at) AS ord, epoch_us(received_at) >= {LATER} AS late FROM decisions WHERE idea.key IS NOT NULL AND received_at IS NOT NULL)"""
#: The same turn without the first strategy and without a past.
_SECOND = """,
u2 AS (SELECT * FROM u WHERE ord > 0),
f2 AS (SELECT * FROM u2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord, updated NULLS FIRST, description NULLS FIRST, idea_type NULLS FIRST, approved NULLS FIRST) = 1),
j2 AS (SELECT key, strategy, coalesce(length(description) >= 120, false) AS long_enough, idea_type IS NOT NULL AS typed, coalesce(approved, false) AS approved FROM f2),
d2 AS (SELECT *, CASE long_enough::int + typed::int + approved::int WHEN 3 THEN 'accepted' WHEN 0 THEN 'rejected' ELSE 'deferred' END AS status FROM j2) """

QUERIES = {
    "stored_decisions": (stored_decisions, f"WITH {_SPLIT} SELECT key, status, max(ord) AS ord FROM b GROUP BY ALL"),
    "seeded_decisions": (seeded_decisions, f"WITH {_SPLIT}, k AS (SELECT key, status, bool_or(late) AS seeded FROM b GROUP BY ALL) SELECT seeded, status, count(*) AS n FROM k GROUP BY ALL"),
    "stored_turn_diff": (stored_turn_diff, TURN_SQL + _SECOND + """
SELECT 'ideas' AS part, key, 'added' AS change FROM d2 WHERE key NOT IN (SELECT key FROM d) UNION ALL SELECT 'ideas', key, 'removed' FROM d WHERE key NOT IN (SELECT key FROM d2)
UNION ALL SELECT DISTINCT 'strategies', strategy, 'added' FROM j2 WHERE strategy NOT IN (SELECT strategy FROM j) UNION ALL SELECT DISTINCT 'strategies', strategy, 'removed' FROM j WHERE strategy NOT IN (SELECT strategy FROM j2)
UNION ALL SELECT 'criteria', coalesce(d.key, d2.key), 'changed' FROM d FULL JOIN d2 ON d.key = d2.key WHERE (d.long_enough, d.typed, d.approved) IS DISTINCT FROM (d2.long_enough, d2.typed, d2.approved)
UNION ALL SELECT 'decisions_added', key || ':' || status, 'added' FROM d2 WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.key = d2.key AND d.status = d2.status)
UNION ALL SELECT 'decisions_removed', key || ':' || status, 'removed' FROM d WHERE NOT EXISTS (SELECT 1 FROM d2 WHERE d.key = d2.key AND d.status = d2.status)"""),
    "event_days": (event_days, "SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'none') AS day, count(*) AS n, count(DISTINCT event_id) AS events FROM actor_events GROUP BY 1"),
    "latest_items": (latest_items, "SELECT id, max(epoch_us(updated_at)) AS u FROM workflow_items WHERE id IS NOT NULL GROUP BY id"),
    "jsonl_round_trip": (jsonl_round_trip, "SELECT approved, count(*) AS n, count(DISTINCT id) AS ids, sum(length(description))::BIGINT AS chars FROM base_ideas GROUP BY approved"),
    "json_update": (json_update, "SELECT n_nationkey::BIGINT AS k, lower(n_name) AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 1"),
    "yaml_documents": (yaml_documents, "SELECT 'region_' || r_regionkey || '.yaml' AS file, r_name AS name, r_regionkey::BIGINT AS k FROM region"),
    "text_files": (text_files, "SELECT n_name AS name FROM nation"),
    "jsonable_items": (jsonable_items, "SELECT DISTINCT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, status.branch AS branch, status.approved::VARCHAR AS approved FROM workflow_items"),
    "delivery_sizes": (delivery_sizes, "SELECT snapshot_no, count(*) AS n, count(DISTINCT lower(trim(turn_id))) AS turns FROM turn_snapshots GROUP BY ALL"),
}
