"""Trees of items: ancestors, descendants, the first matching node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions.geometry import large_arc, on_circle
from inkweave.session import cut


def ancestors(items: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Each item with each of its ancestors: ``key, ancestor, level`` (1: its parent).

    Pointer doubling: after n rounds the links of up to 2^n levels are known, so the number of joins
    grows with the logarithm of the depth, which has no limit. Each round is cut off and keeps new links only, so a
    circle of parents ends when all of it is known. Null keys and unknown parents have no links.
    """
    known = items.select(F.col(key).alias("k")).where("k is not null").distinct()
    edges = items.where(F.col(key).isNotNull() & F.col(parent).isNotNull() & (F.col(key) != F.col(parent))).select(F.col(key).alias("k"), F.col(parent).alias("a")).distinct()
    links = cut(edges.join(known.withColumnRenamed("k", "a"), "a", "left_semi").withColumn("level", F.lit(1)))
    reach = 1
    while True:
        further = links.where(F.col("level") == reach).select("k", F.col("a").alias("m")).join(links.select(F.col("k").alias("m"), "a", (F.col("level") + reach).alias("level")), "m").select("k", "a", "level")
        # Of several ways to one ancestor, which only circles have, the shortest counts.
        further = further.where(F.col("k") != F.col("a")).groupBy("k", "a").agg(F.min("level").alias("level")).join(links.select("k", "a"), ["k", "a"], "left_anti")
        further = cut(further.select("k", "a", "level"))
        if further.isEmpty():
            break
        links, reach = links.unionByName(further), reach * 2
    return links.groupBy("k", "a").agg(F.min("level").alias("level")).select(F.col("k").alias(key), F.col("a").alias("ancestor"), "level")


def placed(items: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Each item with its root, its depth and the path of keys from the root."""
    up = ancestors(items, key, parent)
    lined = up.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("n"), "ancestor"))).alias("up"))
    path = F.concat(F.coalesce(F.col("up.ancestor"), F.array().cast("array<string>")), F.array(F.col(key)))
    joined = items.select(key).where(F.col(key).isNotNull()).distinct().join(lined, key, "left")
    return joined.select(key, F.element_at(path, 1).alias("root"), (F.size(path) - 1).alias("depth"), F.array_join(path, "/").alias("path"))


def children(items: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """How many children each item has."""
    count = items.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.count("*").alias("children"))
    return items.select(key).join(count, key, "left").select(key, F.coalesce("children", F.lit(0).cast("long")).alias("children"))


def first_matching(items: DataFrame, matches: Column, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """For each root the first node of its tree that matches, children before their parent, siblings by key.

    In this order a node comes after everything below it, which sorting by the path with a last mark
    greater than any key gives without walking the tree.
    """
    order = F.concat(F.col("path"), F.lit("/\U0010ffff"))
    hit = items.where(matches).select(key).join(placed(items, key, parent), key)
    return hit.groupBy("root").agg(F.min_by(key, order).alias("first_match"), F.count("*").alias("matches"))


REBUTTAL = "Rebuttal - "


def flatten_nodes(clips: DataFrame) -> DataFrame:
    """Nodes of a row of segments from ``segment, position, title``: the first clip of each is a ``square``,
    the others a ``dot``, unless their titles begin with ``Rebuttal - ``; nodes are numbered through. If the
    first segment's last clip is such a one, a node ``rebuttal`` comes after all others.

    Numbering is by counts per segment, which are few; no task holds all nodes.
    """
    rebuts = F.col("title").startswith(REBUTTAL)
    kept = clips.where((F.col("position") == 0) | ~F.coalesce(rebuts, F.lit(False)))
    inside = kept.withColumn("__n", F.row_number().over(Window.partitionBy("segment").orderBy("position")) - 1)
    sizes = kept.groupBy("segment").agg(F.count("*").alias("__size"))
    offsets = sizes.withColumn("__offset", F.sum("__size").over(Window.orderBy("segment")) - F.col("__size"))
    nodes = inside.join(offsets, "segment").select("segment", "title", F.when(F.col("position") == 0, "square").otherwise("dot").alias("kind"), (F.col("__offset") + F.col("__n")).alias("idx"))
    ends = clips.groupBy("segment").agg(F.max_by("title", "position").alias("title"), F.max("position").alias("last")).orderBy("segment").limit(1)
    last = ends.where(F.col("title").startswith(REBUTTAL) & (F.col("last") > 0)).join(sizes.agg(F.sum("__size").alias("idx")))
    return nodes.unionByName(last.select("segment", "title", F.lit("rebuttal").alias("kind"), "idx"))


def arcs(nodes: DataFrame, x: float = 0.0, y: float = 0.0, radius: float = 1.0, gap: float = 0.0) -> DataFrame:
    """The arc between each two neighbouring nodes of a segment on a circle: its angles, less a gap at both
    ends, and whether it is more than half a turn. The rebuttal has none."""
    total = nodes.agg(F.count("*").alias("total"))
    placed_ = nodes.join(F.broadcast(total)).withColumn("theta", on_circle(F.col("idx"), F.col("total"), x, y, radius)[0]).where("kind <> 'rebuttal'")
    after = F.lead("theta").over(Window.partitionBy("segment").orderBy("idx"))
    ended = placed_.withColumn("end_theta", after).where("end_theta is not null")
    begin, end = F.col("theta") + gap, F.col("end_theta") - gap
    return ended.select("segment", "idx", begin.alias("begin_theta"), end.alias("end_theta"), large_arc(begin, end).alias("large"))


def segment_ranges(nodes: DataFrame) -> DataFrame:
    """The first and last node of each segment."""
    return nodes.groupBy("segment").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
