"""What changed between full snapshots of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions.jsonvalue import canonical_text, digest
from inkweave.session import cut


def hashed_rows(df: DataFrame, snapshot: str, key: str, values: list[str], loaded: str | None) -> DataFrame:
    """``snapshot, key, value``: one row for each key of each snapshot, with a hash of the JSON columns ``values``.

    Keys are trimmed and in lower case. Of several rows for one key in one snapshot, the last loaded one
    counts, the greatest hash where that ties. The JSON texts stay where they are read: only hashes are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k.strip().lower() for k in batch.column(1).to_pylist()]
            texts = zip(*(c.to_pylist() for c in batch.columns[3:]))
            hashes = [digest([canonical_text(t) for t in row]) for row in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), batch.column(2), pa.array(hashes, pa.string())], ["snapshot", "key", "loaded", "value"])

    when = F.col(loaded).cast("timestamp") if loaded else F.lit(None).cast("timestamp")
    rows = df.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(
        F.col(snapshot).cast("long").alias("snapshot"), F.col(key).cast("string").alias("key"), F.unix_micros(when).alias("loaded"),
        *(F.col(v).cast("string").alias(f"v{i}") for i, v in enumerate(values)),
    )
    hashed = rows.mapInArrow(run, "snapshot long, key string, loaded long, value string").where("key <> ''")
    last = F.max(F.struct(F.coalesce("loaded", F.lit(-(1 << 62))).alias("loaded"), "value"))
    return hashed.groupBy("snapshot", "key").agg(last.alias("last")).select("snapshot", "key", F.col("last.value").alias("value"))


def validity_intervals(rows: DataFrame) -> DataFrame:
    """``key, value, first, last``: the longest runs of consecutive existing snapshots in which a key has one value.

    Gaps and islands: a snapshot's rank less the row's number among the key's rows of that value is
    the same within a run and grows from run to run.
    """
    # The distinct snapshot numbers are few (one for each delivery), so ranking them in one task is no bottleneck.
    ranks = rows.select("snapshot").distinct().withColumn("rank", F.row_number().over(Window.orderBy("snapshot")))
    island = F.col("rank") - F.row_number().over(Window.partitionBy("key", "value").orderBy("rank"))
    return (
        rows.join(F.broadcast(ranks), "snapshot").withColumn("island", island)
        .groupBy("key", "value", "island").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
        .select("key", "value", "first", "last")
    )


def change_events(rows: DataFrame) -> DataFrame:
    """``snapshot, key, change_kind`` from the rows of all snapshots, each under the newer snapshot."""
    ranks = rows.select("snapshot").distinct().withColumn("rank", F.row_number().over(Window.orderBy("snapshot")))
    end = ranks.agg(F.max("rank").alias("end"))
    by_key = Window.partitionBy("key").orderBy("first")
    spans = validity_intervals(rows).withColumns({"before": F.lag("last").over(by_key), "after": F.lead("first").over(by_key)})
    begun = F.when(F.col("first") > 1, F.struct(F.col("first").alias("rank"), F.when(F.col("before") == F.col("first") - 1, "changed").otherwise("added").alias("change_kind")))
    gone = (F.col("last") < F.col("end")) & (F.col("after").isNull() | (F.col("after") > F.col("last") + 1))
    ended = F.when(gone, F.struct((F.col("last") + 1).alias("rank"), F.lit("removed").alias("change_kind")))
    events = spans.join(F.broadcast(end)).select("key", F.explode(F.array_compact(F.array(begun, ended))).alias("e"))
    return events.select("key", "e.*").join(F.broadcast(ranks), "rank").select("snapshot", "key", "change_kind")


def snapshot_changes(df: DataFrame, snapshot: str, key: str, values: list[str], loaded: str | None = None) -> DataFrame:
    """The records added, removed and changed at each snapshot against the next lower existing one.

    Method: gaps and islands over key and row hash give validity intervals; an interval's start is an
    addition or, next to another interval of the key, a change; an end with nothing after it is a removal.
    Null snapshots and null or blank keys: no record. Repeated and late rows: the last loaded counts.
    Null and blank JSON texts are equal; a text that is no JSON is compared as it stands, trimmed. One
    snapshot or an empty table: no rows. Other columns are not read.
    """
    return change_events(cut(hashed_rows(df, snapshot, key, values, loaded)))  # else every use of the rows would hash all texts again
