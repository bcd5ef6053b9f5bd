"""Operators on rows in an order: repeats, transitions, islands, clamping, chunks, successors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_repeats(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Without the rows whose value equals that of the row before; values that are null or blank go first."""
    said = df.where(F.trim(value) != "")
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return said.withColumn("__before", before).where(~F.col("__before").eqNullSafe(F.col(value))).drop("__before")


def transitions(df: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """The rows in which a state differs from that of the row before, with ``was``; each first row is one from null."""
    return df.withColumn("was", F.lag(state).over(Window.partitionBy(*by).orderBy(*order))).where(~F.col("was").eqNullSafe(F.col(state)))


def islands(df: DataFrame, by: list[str], position: str, gap: int = 1) -> DataFrame:
    """Rows with the number of their run (``island``, from 0): a step of more than ``gap`` begins a new one."""
    w = Window.partitionBy(*by).orderBy(position)
    broken = (F.col(position) - F.lag(position).over(w) > gap).cast("int")
    return df.withColumn("__broken", F.coalesce(broken, F.lit(0))).withColumn("island", F.sum("__broken").over(w)).drop("__broken")


def clamped(rows: Column) -> Column:
    """Segments (structs of ``text, start, end`` in order) that don't go back in time: a start before the last
    end becomes 0.01 after it, then an end before its start 0.01 after that.

    Each depends on the one before as changed, so this is a fold over one recording's array.
    """

    def step(done: Column, row: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1)["end"])
        start = F.when(last.isNotNull() & (row["start"] < last), last + 0.01).otherwise(row["start"])
        end = F.when(row["end"] < start, start + 0.01).otherwise(row["end"])
        return F.concat(done, F.array(F.struct(row["text"].alias("text"), start.alias("start"), end.alias("end"))))

    empty = F.from_json(F.lit("[]"), "array<struct<text:string,start:double,end:double>>")
    return F.aggregate(rows, empty, step)


def chunks(length: Column, size: int, overlap: int) -> Column:
    """The chunks of something ``length`` long, each with some of the next one: an array of ``begin, end``."""
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("long"), (length - 1).cast("long"), F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("begin"), F.least(s + size + overlap, length.cast("long")).alias("end")))


def successors(paths: DataFrame) -> DataFrame:
    """From ``branch, steps (array)`` each step with its position, the next and the previous one."""
    exploded = paths.select("branch", F.posexplode("steps").alias("position", "step"))
    w = Window.partitionBy("branch").orderBy("position")
    return exploded.withColumns({"next_step": F.lead("step").over(w), "previous_step": F.lag("step").over(w)})


def merged_runs(df: DataFrame, by: list[str], order: str, same: list[str], fields: str) -> DataFrame:
    """Neighbouring rows that agree in ``same`` as one, their maps merged in order, later values winning."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    runs = df.withColumn("__new", changed.cast("int")).withColumn("run", F.sum("__new").over(w))
    keys = [*by, "run", *same]
    # The last value of each key of the maps: combined before the shuffle, so a long run isn't gathered anywhere.
    entries = runs.select(*keys, order, F.explode(fields).alias("__k", "__v")).groupBy(*keys, "__k").agg(F.max_by("__v", order).alias("__v"))
    merged = entries.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias(fields))
    counted = runs.groupBy(*keys).agg(F.count("*").alias("rows"))
    both = counted.alias("c").join(merged.alias("m"), [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], "left")
    return both.select(*(F.col(f"c.{k}").alias(k) for k in keys), "rows", fields)


def laid_out(df: DataFrame, by: list[str], order: str, height: str, gap: str, frame: float | None = None) -> DataFrame:
    """The offset of each block of a column of blocks (``top``), and its total height.

    In a ``frame`` that is too small the gaps shrink in proportion, to nothing at most.
    """
    w, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    gaps, total = F.sum(gap).over(whole), F.sum(F.col(height) + F.col(gap)).over(whole)
    share = F.lit(1.0) if frame is None else F.when((total > frame) & (gaps > 0), F.greatest(F.lit(0.0), 1 - (total - frame) / gaps)).otherwise(1.0)
    sized = df.withColumn("__size", F.col(height) + F.col(gap) * share)
    return sized.withColumn("top", F.sum("__size").over(w) - F.col("__size")).withColumn("total_height", F.sum("__size").over(whole)).drop("__size")


def wrapped(words: Column, width: int) -> Column:
    """An array of words as lines of at most ``width`` characters, filled greedily; a longer word has a line of its own."""

    def step(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.char_length(last) + 1 + F.char_length(word) <= width)
        grown = F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), word)))
        return F.when(fits, grown).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(words, F.array().cast("array<string>"), step)
