"""Keep-first, keep-last, keyed upserts, anti filters and differences of two sets of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of the rows of each key the first by ``order`` (nulls first). Spark bounds the rows it sorts per key by a group limit before the shuffle."""
    return _ranked(df, keys, [F.asc_nulls_first(o) for o in order])


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of the rows of each key the last by ``order`` (nulls before everything)."""
    return _ranked(df, keys, [F.desc_nulls_last(o) for o in order])


def top_per_key(df: DataFrame, keys: list[str], limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each key with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)


def not_in(df: DataFrame, others: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """The rows whose key isn't among the others' (a null key is never)."""
    known = others.select(F.col(other_key or key).alias(key)).where(F.col(key).isNotNull()).distinct()
    return df.join(known, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, fields: str, ord_: str) -> DataFrame:
    """Keyed upsert of ``key, fields (map), ord``: of several new rows for a key the last counts; a known
    key keeps its place and its map is merged with the new one, whose null values win and whose missing
    keys change nothing; other keys come after, in the order of their first new row."""
    was = keep_last(old, [key], ord_).join(old.groupBy(key).agg(F.min(ord_).alias("__first")), key).select(key, F.col(fields).alias("__old"), F.col("__first").alias("__place"))
    now = keep_last(new, [key], ord_).join(new.groupBy(key).agg(F.min(ord_).alias("__come")), key).select(key, F.col(fields).alias("__new"), "__come")
    both = was.join(now, key, "full_outer")
    merged = F.when(F.col("__new").isNull(), F.col("__old")).when(F.col("__old").isNull(), F.col("__new")).otherwise(F.map_concat("__old", "__new"))
    return both.select(key, merged.alias(fields), F.col("__place").isNull().cast("int").alias("is_new"), F.coalesce("__place", "__come").alias(ord_))


def key_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The keys only one side has, with ``change`` added or removed."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def value_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """The keys whose values differ, null-safely, with both values; a missing key counts as null. Keys are unique on each side."""
    a, b = old.select(key, F.col(value).alias("was")), new.select(key, F.col(value).alias("now"))
    return a.join(b, key, "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))


def rows_not_in(new: DataFrame, old: DataFrame) -> DataFrame:
    """The rows of one frame, repeats and all, that equal no row of the other, null-safely in every column."""
    row = F.md5(F.to_json(F.struct(*sorted(new.columns)), {"ignoreNullFields": "false"}).cast("binary"))
    return new.withColumn("__row", row).join(old.select(*new.columns).select(row.alias("__row")).distinct(), "__row", "left_anti").drop("__row")


def shared_tokens(a: Column, b: Column) -> Column:
    """The distinct tokens that two arrays share."""
    return F.array_intersect(a, b)
