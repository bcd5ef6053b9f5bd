"""Scores over time: sliding windows, groups of labels, from coarse to fine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.operators.sequences import chunks

__all__ = ["chunks", "clip_name", "clip_samples", "coarse_to_fine", "group_windows", "sample_windows", "strongest_frames"]


def sample_windows(samples: Column, rate: int, window: float, hop: float) -> Column:
    """The windows of an array of samples as structs of ``start, end`` (seconds) and ``part``; a window that
    would begin where only one window's length is left isn't taken."""
    size, step = int(window * rate), max(1, int(hop * rate))
    last = F.size(samples) - size - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct((s / F.lit(float(rate))).alias("start"), ((s + size) / F.lit(float(rate))).alias("end"), F.slice(samples, s + 1, size).alias("part")))


def clip_samples(samples: Column, rate: int, start_ms: Column, end_ms: Column) -> Column:
    """The samples from a time to before another."""
    first, last = F.floor(start_ms * rate / 1000).cast("int"), F.floor(end_ms * rate / 1000).cast("int")
    return F.slice(samples, first + 1, F.greatest(last - first, F.lit(0)))


def clip_name(prefix: str, start_ms: Column, end_ms: Column, kind: str = "wav") -> Column:
    """The name of a clip's file."""
    return F.format_string(f"{prefix}_%d_%d.{kind}", start_ms, end_ms)


def group_windows(detections: DataFrame, groups: DataFrame, seconds: int) -> DataFrame:
    """The greatest score of each group of labels in each window of ``start`` (a timestamp).

    ``groups`` has ``label, group_name``; of several groups for a label the last by name counts, labels
    without one are dropped. Whether the small side is broadcast is left to Spark, which knows its size.
    """
    of = groups.groupBy("label").agg(F.max("group_name").alias("group_name"))
    begin = F.floor(F.unix_micros("start") / (seconds * 1_000_000)).cast("long") * seconds
    return detections.join(of, "label").groupBy(begin.alias("window_start"), "group_name").agg(F.max("score").alias("score"), F.count("*").alias("n"))


def coarse_to_fine(detections: DataFrame, groups: DataFrame, coarse: int, fine: int, threshold: float | DataFrame) -> DataFrame:
    """The fine windows inside coarse windows in which some group reaches the threshold.

    ``threshold`` is a number for all groups, a frame of one row ``threshold``, or one of ``group_name,
    threshold`` with a number for each (groups without one don't count).
    ``coarse`` is a whole number of ``fine``, so containment is equality of the coarse window: a semi join
    on it, before the finer aggregation, instead of a join of intervals.
    """
    found = group_windows(detections, groups, coarse)
    if isinstance(threshold, DataFrame):
        found = found.join(threshold, "group_name") if "group_name" in threshold.columns else found.join(F.broadcast(threshold.limit(1)))
    else:
        found = found.withColumn("threshold", F.lit(threshold))
    kept = found.where(F.col("score") >= F.col("threshold")).select(F.col("window_start").alias("coarse_start")).distinct()
    inside = detections.withColumn("coarse_start", F.floor(F.unix_micros("start") / (coarse * 1_000_000)).cast("long") * coarse).join(kept, "coarse_start", "left_semi")
    return group_windows(inside, groups, fine)


def strongest_frames(frames: DataFrame, pattern: str, threshold: float) -> DataFrame:
    """From ``idx, frames, seconds, scores (map of class to score)`` the classes that match a pattern and
    exceed a threshold, with the frame's time; a frame lasts 0.975 seconds."""
    long = frames.select("*", F.explode("scores").alias("label", "score")).where(F.lower("label").rlike(pattern) & (F.col("score") > threshold))
    start = F.col("idx") * F.col("seconds") / F.col("frames")
    return long.select("idx", "label", "score", start.alias("start"), (start + 0.975).alias("end"))
