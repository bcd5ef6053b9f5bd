"""The event log as a stream: windowed counts with late data, and state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkweave.session import cut, remove, scratch


def event_stream(spark: SparkSession, path: str, at: str = "ts") -> DataFrame:
    """A parquet file or folder as a stream, its event time as a timestamp (watermarks need one)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    # A folder of files is read as it is; a single file by its folder and name.
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    is_file = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    stream = stream.option("pathGlobFilter", name).parquet(folder) if is_file else stream.parquet(path)
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def window_counts(events: DataFrame, by: list[str], width: str = "1 hour", late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Events in each window; state of windows older than the watermark is dropped."""
    counted = events.where(F.col(at).isNotNull()).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.unix_micros("w.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Session windows of each key."""
    found = events.where(F.col(at).isNotNull()).withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.unix_micros("w.start").alias("session_start"), F.unix_micros("w.end").alias("session_end"), "n")


def state_changes(events: DataFrame, key: str, state: str, at: str = "ts") -> DataFrame:
    """A row whenever a key's state differs from its last one: ``key, was, now, at``, in event time within each batch."""
    kind = events.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("was", T.StringType()), T.StructField("now", T.StringType()), T.StructField("at", T.TimestampType())])

    def run(group: tuple, frames: Iterator[pd.DataFrame], had: GroupState) -> Iterator[pd.DataFrame]:
        last = had.get[0] if had.exists else None
        rows = pd.concat(list(frames)).sort_values("at") if had is not None else pd.DataFrame()
        found = []
        for now, when in zip(rows["now"], rows["at"]):
            if now != last:
                found.append((*group, last, now, when))
                last = now
        had.update((last,))
        yield pd.DataFrame(found, columns=[key, "was", "now", "at"])

    rows = events.where(F.col(key).isNotNull()).select(key, F.col(state).cast("string").alias("now"), F.col(at).alias("at"))
    return rows.groupBy(key).applyInPandasWithState(run, out, "last string", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now, into a table in the shared folder, and gives what is in it.

    ``complete`` results are written anew by every batch, ``append`` ones added.
    """
    spark = stream.sparkSession
    path, marks = scratch(spark, "stream"), scratch(spark, "marks")
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    query.option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    found = cut(spark.read.schema(stream.schema).parquet(path))
    for folder in (path, marks):
        remove(spark, folder)
    return found
