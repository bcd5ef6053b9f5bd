"""Stores of decisions, turns, items and events as append-only or versioned tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.operators.keyed import keep_last
from inkweave.sources.files import Files, read_text, write_document

STATUSES = ("accepted", "rejected", "deferred")
DECISION = "decision_id string, turn_id string, ts timestamp_ntz, idea struct<key:string,idea:string>, rationale string, status string, ord long"


class Versioned:
    """A table whose every state is a folder; the newest complete one counts. Readers never see half of a write."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema, self.files = spark, path.rstrip("/"), schema, Files(spark)

    def _versions(self) -> list[int]:
        return sorted(int(n[2:]) for n, _, _ in self.files.listed(self.path) if n.startswith("v=") and self.files.exists(f"{self.path}/{n}/_SUCCESS"))

    def load(self) -> DataFrame:
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={found[-1]}")

    def save(self, df: DataFrame, keep: int = 2) -> None:
        found = self._versions()
        df.write.mode("overwrite").parquet(f"{self.path}/v={found[-1] + 1 if found else 0}")
        for old in found[: max(0, len(found) + 1 - keep)]:
            self.files.delete(f"{self.path}/v={old}")

    def update(self, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Save what a change makes of the present state, and give it back."""
        self.save(change(self.load()))
        return self.load()


class Appended:
    """A table of batches, each a folder that is complete or not there for readers.

    An append writes its batch only, however long the history. ``compact`` writes a folder that stands for
    every batch before it, and deletes those after it is complete; a crash in between leaves both, of which
    readers take the former.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema, self.files = spark, path.rstrip("/"), schema, Files(spark)

    def batches(self) -> tuple[int | None, list[int]]:
        """The number of the last compacted batch, and those after it."""
        names = [n for n, _, _ in self.files.listed(self.path) if n.split("=")[0] in ("batch", "upto") and self.files.exists(f"{self.path}/{n}/_SUCCESS")]
        upto = max((int(n[5:]) for n in names if n.startswith("upto=")), default=None)
        return upto, sorted(int(n[6:]) for n in names if n.startswith("batch=") and (upto is None or int(n[6:]) > upto))

    def append(self, df: DataFrame) -> int:
        upto, later = self.batches()
        number = max([-1 if upto is None else upto, *later]) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        return number

    def read(self) -> DataFrame:
        """All rows, with the number of their batch as ``batch``."""
        upto, later = self.batches()
        out = self.spark.createDataFrame([], f"{self.schema}, batch long")
        if upto is not None:
            out = out.unionByName(self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.path}/upto={upto}"))
        if later:
            rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/batch={n}" for n in later))
            number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/[^/]*$", 1).cast("long")
            out = out.unionByName(rows.withColumn("batch", number))
        return out

    def compact(self, of: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """All batches as one folder; ``of`` may drop rows that no longer count."""
        upto, later = self.batches()
        if not later:
            return
        of(self.read()).write.mode("overwrite").parquet(f"{self.path}/upto={later[-1]}")
        for name in ([] if upto is None else [f"upto={upto}"]) + [f"batch={n}" for n in later]:
            self.files.delete(f"{self.path}/{name}")


class DecisionStore(Appended):
    """Decisions in buckets by status; of several for one key in one bucket the last counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, DECISION)

    def add(self, decisions: DataFrame, turn_id: str | None = None) -> None:
        """Append; a status that is none of the three raises and leaves the store as it was. ``turn_id`` names the
        turn of all of them, as for those seeded by hand."""
        said = F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null")))
        known = F.when(F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.col("status")).otherwise(F.raise_error(said))
        if turn_id is not None:
            decisions = decisions.withColumn("turn_id", F.lit(turn_id))
        names = ["decision_id", "turn_id", "ts", "idea", "rationale", "status", "ord"]
        try:
            self.append(decisions.withColumn("status", known).select(*names))
        except Exception as e:
            if "unknown status: " in str(e):
                raise ValueError("unknown status") from e
            raise

    def load(self) -> DataFrame:
        """The decisions that count."""
        return self._last(self.read()).drop("batch")

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        return keep_last(rows.withColumn("__key", F.col("idea.key")), ["status", "__key"], "batch", "ord").drop("__key")

    def compact(self) -> None:
        """Keep what counts only."""
        super().compact(self._last)

    def counts(self) -> DataFrame:
        """How many decisions each bucket has, empty buckets too."""
        buckets = self.spark.createDataFrame([(s,) for s in STATUSES], "status string")
        return buckets.join(self.load().groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


class TurnStore:
    """Whole turns: their ideas, criteria and decisions, each turn's batches under its id."""

    PARTS = ("ideas", "criteria", "decisions")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def save(self, turn_id: str, **parts: DataFrame) -> None:
        """Save a turn's parts; it is there for readers when the last is complete. A turn of the same id is replaced."""
        fresh = f"{self.path}/.new-{turn_id}"
        for name in self.PARTS:
            parts[name].write.mode("overwrite").parquet(f"{fresh}/{name}")
        self.files.replace(fresh, f"{self.path}/turn={turn_id}")

    def turns(self) -> list[str]:
        """The ids of the stored turns, in the order of their names."""
        return [n[5:] for n, _, _ in self.files.listed(self.path) if n.startswith("turn=")]

    def load(self, turn_id: str) -> dict[str, DataFrame]:
        """A turn's parts; a turn that isn't there raises."""
        where = self.files.settled(f"{self.path}/turn={turn_id}")
        return {name: self.spark.read.parquet(f"{where}/{name}") for name in self.PARTS}


class Instance:
    """A folder with a configuration, a store of decisions and one of turns."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.decisions, self.turns = DecisionStore(spark, f"{self.path}/decisions"), TurnStore(spark, f"{self.path}/turns")

    def create(self, config: dict) -> Instance:
        """Make the folders and write the configuration; one that is there is replaced."""
        for name in ("decisions", "turns"):
            self.files.make(f"{self.path}/{name}")
        write_document(self.spark, f"{self.path}/config.json", config)
        return self

    def config(self) -> dict:
        """The configuration; without one it raises."""
        where = self.files.settled(f"{self.path}/config.json")
        if not self.files.exists(where):
            raise FileNotFoundError(where)
        return json.loads(read_text(self.spark, where).first().text)


class ItemStore:
    """Records by key, each in its latest version, with a log of what was done to them."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, version: str) -> None:
        self.key, self.version = key, version
        self.rows = Appended(spark, f"{path.rstrip('/')}/items", schema)
        self.progress = EventLog(spark, f"{path.rstrip('/')}/progress")

    def put(self, rows: DataFrame) -> None:
        self.rows.append(rows)

    def get(self, *keys: object) -> DataFrame:
        """The latest version of each record, or of those with some keys."""
        rows = self.rows.read()
        rows = rows.where(F.col(self.key).isin(*keys)) if keys else rows
        return keep_last(rows, [self.key], self.version, "batch").drop("batch")

    def log(self, events: DataFrame, at: str = "ts") -> None:
        self.progress.append(events, at)


class EventLog:
    """An append-only log of events, partitioned by day so that old days can be compacted or dropped by folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def append(self, events: DataFrame, at: str = "ts") -> None:
        events.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(self.path)

    def read(self) -> DataFrame:
        for name, _, _ in self.files.listed(self.path, hidden=True):
            if name.startswith(".old-day="):
                self.files.settled(f"{self.path}/{name[5:]}")
        return self.spark.read.parquet(self.path)

    def compact(self, day: str, size: int = 128 << 20) -> None:
        """One day's small files as few of about ``size`` bytes, which take the old ones' place when they are complete."""
        where = f"{self.path}/day={day}"
        total = sum(n for _, n, _ in self.files.listed(where))
        fresh = f"{self.path}/.new-day={day}"
        self.spark.read.parquet(where).repartition(max(1, -(-total // size))).write.mode("overwrite").parquet(fresh)
        self.files.replace(fresh, where)

    def rotate(self, size: int = 50 << 20) -> list[str]:
        """Compact the days of several files whose files are small on average; gives the days."""
        parts: dict[str, int] = {}
        for name, _, _ in self.files.listed(self.path):
            files = [n for f, n, _ in self.files.listed(f"{self.path}/{name}")] if name.startswith("day=") else []
            if len(files) > 1 and sum(files) < size * len(files):
                parts[name[4:]] = max(1, -(-sum(files) // size))
        if parts:
            fresh = f"{self.path}/.rotated"
            day = F.regexp_extract(F.col("_metadata.file_path"), r"/day=([^/]*)/[^/]*$", 1)
            place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))  # the same when a lost task is run again
            rows = self.spark.read.parquet(*(f"{self.path}/day={d}" for d in parts)).withColumns({"day": F.url_decode(day), "__place": place})
            # All days in one job; a day of many files' size goes to as many tasks.
            several = F.coalesce(F.create_map(*(F.lit(x) for item in parts.items() for x in item))[F.col("day")], F.lit(1))
            rows.repartition("day", F.pmod("__place", several)).drop("__place").write.mode("overwrite").partitionBy("day").parquet(fresh)
            for d in parts:
                self.files.replace(f"{fresh}/day={d}", f"{self.path}/day={d}")
            self.files.delete(fresh)
        return [*parts]

    def drop(self, before: Column | str) -> list[str]:
        """Delete the folders of days before one (``YYYY-MM-DD``); gives the days."""
        days = [n[4:] for n, _, _ in self.files.listed(self.path) if n.startswith("day=") and n[4:] < before and n[4:5].isdigit()]
        for day in days:
            self.files.delete(f"{self.path}/day={day}")
        return days
