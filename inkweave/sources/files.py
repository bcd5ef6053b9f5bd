"""Readers and writers of record files, and the life of files on any Hadoop file system."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: ``path, text``."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON document a file; with a schema typed, else as a variant ``value``."""
    if schema is not None:
        return spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)
    return read_text(spark, path).select("path", F.try_parse_json("text").alias("value"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "FAILFAST") -> DataFrame:
    """One JSON record a line; blank lines are skipped, a broken one fails unless ``mode`` drops it."""
    return spark.read.schema(schema).json(path, mode=mode)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records as JSON lines; the commit protocol shows readers all of it or nothing."""
    df.write.mode(mode).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """More records behind those that are there."""
    df.write.mode("append").json(path)


def write_text(df: DataFrame, path: str) -> None:
    """A single text column as lines."""
    df.write.mode("overwrite").text(path)


def update_json(spark: SparkSession, path: str, updater: Callable[[DataFrame], DataFrame], schema: T.StructType | str, default: DataFrame | None = None) -> DataFrame:
    """Read, change, write: into a new version beside the old one, which it replaces when it is complete."""
    files = Files(spark)
    path = files.settled(path)
    if files.exists(path):
        now = spark.read.schema(schema).json(path)
    elif default is not None:
        now = default
    else:
        raise FileNotFoundError(path)
    head, _, name = path.rpartition("/")
    fresh = f"{head}/.new-{name}"
    updater(now).write.mode("overwrite").json(fresh)
    files.replace(fresh, path)
    return spark.read.schema(schema).json(path)


def write_document(spark: SparkSession, path: str, value: object, indent: int | None = 2, sort_keys: bool = False) -> None:
    """One JSON document of a bounded size as a file, which takes an old one's place in one step."""
    Files(spark).write(path, json.dumps(value, indent=indent, sort_keys=sort_keys, ensure_ascii=False, default=str) + "\n")


def write_yaml(spark: SparkSession, path: str, value: object, sort_keys: bool = False) -> None:
    """One document of a bounded size as a YAML file, keys in their order unless sorted; without PyYAML as JSON, which is YAML too."""
    value = json.loads(json.dumps(value, default=str))
    try:
        import yaml
    except ImportError:
        return write_document(spark, path, value, sort_keys=sort_keys)
    return Files(spark).write(path, yaml.safe_dump(value, sort_keys=sort_keys, allow_unicode=True))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """YAML files as ``path`` and JSON text ``value``; needs PyYAML on the executors, and raises ImportError where it is missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            yield pd.DataFrame({"path": batch.path, "value": [json.dumps(yaml.safe_load(t), default=str) for t in batch.text]})

    return read_text(spark, path).mapInPandas(run, "path string, value string")


def read_log(df: DataFrame, text: str) -> DataFrame:
    """The lines ``ts [LEVEL] logger: message`` of a text column, with its other columns; other lines are left out."""
    line = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:,\d+)? \[([A-Z]+)\] ([^:\s]+): ([^\n]*)\z"
    lines = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").rlike(line))
    part = lambda i: F.regexp_extract("line", line, i)
    return lines.select(*[c for c in df.columns if c != text], "line_no", part(1).alias("logged_at"), part(2).alias("level"), part(3).alias("logger"), part(4).alias("message"))


def jsonable(df: DataFrame) -> DataFrame:
    """Times as ISO text, everything nested as JSON text, so that any sink for plain records takes it."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def is_hidden(name):
    """Whether a file's name begins with a dot."""
    return name.startswith(".")


def has_suffix(name, *suffixes: str):
    """Whether a file's name ends in one of some suffixes, in any case."""
    return F.lower(name).rlike(rf"\.({'|'.join(suffixes)})$")


class Files:
    """Directories and files on the file system of their path."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> str:
        p, fs = self._at(path)
        fs.mkdirs(p)
        return path

    def delete(self, path: str, missing_ok: bool = True, recursive: bool = True) -> None:
        """A file or folder; one that isn't empty only if ``recursive``."""
        p, fs = self._at(path)
        if not fs.delete(p, recursive) and not missing_ok:
            raise FileNotFoundError(path)

    def move(self, old: str, new: str) -> str:
        p, fs = self._at(old)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"can't move {old} to {new}")
        return new

    def write(self, path: str, text: str) -> None:
        """A small text file: written beside and renamed, so that readers see the old one or the new one."""
        head, _, name = path.rpartition("/")
        fresh = f"{head}/.new-{name}"
        p, fs = self._at(fresh)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.exists(path):
            self.replace(fresh, path)
        else:
            self.move(fresh, path)

    def replace(self, fresh: str, path: str) -> str:
        """Let something complete take another's place: the old one steps aside, the new one takes its name, the old one goes.
        If the process ends in between, :meth:`settled` finishes."""
        self.settled(path)
        head, _, name = path.rpartition("/")
        if self.exists(path):
            self.move(path, f"{head}/.old-{name}")
        self.move(fresh, path)
        self.delete(f"{head}/.old-{name}")
        return path

    def settled(self, path: str) -> str:
        """Finish a replacement that was broken off: without a new one the old one comes back. Gives the path."""
        head, _, name = path.rpartition("/")
        old = f"{head}/.old-{name}"
        if self.exists(old):
            if self.exists(path):
                self.delete(old)
            else:
                self.move(old, path)
        return path

    def copy(self, old: str, new: str) -> str:
        p, fs = self._at(old)
        q, other = self._at(new)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, self.conf)
        return new

    def listed(self, path: str, hidden: bool = False) -> list[tuple[str, int, int]]:
        """The name, size and time of change of each entry of a directory, hidden ones on demand only."""
        p, fs = self._at(path)
        if not fs.exists(p):
            return []
        found = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
        return sorted(f for f in found if hidden or not f[0].startswith((".", "_")))
