"""The event log: recent actions, what to run next, scores of traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent_actions(events: DataFrame, limit: int = 50, since: str | None = None, **equal: str | None) -> DataFrame:
    """The latest events, newest first, with equal columns and not before ``since``; empty filters don't count.

    A limit of less than one gives one row. Filters reach the scan; the limit is a top-k, not a sort.
    """
    for column, value in equal.items():
        if value:
            events = events.where(F.col(column) == value)
    if since:
        events = events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return events.orderBy(F.desc_nulls_last("ts"), F.desc("event_id")).limit(max(1, limit))


def next_run(records: DataFrame, now: Column) -> DataFrame:
    """The record to run next: enabled, cooled down, within budget, with the greatest
    ``static_priority * max(hours since the last run, 0.01) * contextual``, the first by ``ord`` of equals.

    ``records`` has ``name, enabled, cooldown_seconds, budget_per_hour, budget_used, static_priority, contextual, last_run, ord``.
    """
    since = F.coalesce((F.unix_micros(now) - F.unix_micros("last_run")) / 1e6, F.lit(1e9))
    eligible = records.withColumn("since", since).where(F.col("enabled") & (F.col("since") >= F.col("cooldown_seconds")) & (F.col("budget_used") < F.col("budget_per_hour")))
    score = F.col("static_priority") * F.greatest(F.col("since") / 3600, F.lit(0.01)) * F.col("contextual")
    return eligible.withColumn("score", score).orderBy(F.desc("score"), "ord").limit(1)


def case_score(wrong_intent: Column, missing: Column, forbidden: Column) -> Column:
    """1 less 0.4 for another intent and 0.2 for each missing and each forbidden text, at least 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - 0.4 * F.coalesce(wrong_intent, F.lit(True)).cast("int") - 0.2 * missing - 0.2 * forbidden)


def unknown_references(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """The rows that name a key nobody has."""
    return rows.where(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


def scored_candidates(items: DataFrame, query: str, key: str, text: str) -> DataFrame:
    """Candidates for a reference: 1.0 where the key is the query, 0.7 where the text contains it, in any case."""
    score = F.when(F.col(key).cast("string") == query, 1.0).when(F.lower(text).contains(query.lower()), 0.7)
    return items.withColumn("score", score).where("score is not null")


def resolved(items: DataFrame, references: DataFrame) -> DataFrame:
    """Each reference's item by the first rule that finds one: its id, its whole label, a label that ends in
    it, a label that contains it; the least id of equals. ``items`` has ``id, label``, ``references`` ``ref``.

    The first three are equal joins (of the label's ends by words). What they leave may begin and end
    anywhere in a label: it is searched among the labels that have its rarest run of three characters
    (fewer if it is shorter), and compared there. An empty reference is in every label.
    """
    items = items.where("id is not null").select("id", F.lower("label").alias("label"))
    refs = references.where("ref is not null").select("ref", F.lower("ref").alias("r")).distinct()
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("label", " "))), lambda i: F.array_join(F.slice(F.split("label", " "), i, 1000), " "))
    by_id = refs.join(items, refs.ref == items.id).select("ref", "id", F.lit(1).alias("rule"))
    by_label = refs.join(items, F.col("r") == F.col("label")).select("ref", "id", F.lit(2).alias("rule"))
    by_tail = refs.join(items.select("id", F.explode(tails).alias("tail")), F.col("r") == F.col("tail")).select("ref", "id", F.lit(3).alias("rule"))
    told = by_id.unionByName(by_label).unionByName(by_tail)
    left = refs.join(told.select("ref").distinct(), "ref", "left_anti")
    runs = lambda text, n: F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = items.select("id", "label", F.explode(F.array_distinct(F.concat(*(runs("label", n) for n in (1, 2, 3))))).alias("g"))
    asked = left.where("r <> ''").select("ref", "r", F.explode(F.array_distinct(F.when(F.char_length("r") < 3, F.array("r")).otherwise(runs("r", 3)))).alias("g"))
    # A run that no label has rules its reference out: it is the rarest.
    rarest = asked.join(grams.groupBy("g").agg(F.count("*").alias("n")), "g", "left").groupBy("ref", "r").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    by_part = rarest.join(grams, "g").where(F.col("label").contains(F.col("r"))).select("ref", "id", F.lit(4).alias("rule"))
    by_any = left.where("r = ''").select("ref").crossJoin(items.where("label is not null").agg(F.min("id").alias("id"))).where("id is not null").withColumn("rule", F.lit(4))
    found = told.unionByName(by_part).unionByName(by_any)
    return found.groupBy("ref").agg(F.min(F.struct("rule", "id")).alias("best")).select("ref", "best.id", "best.rule")


def choices(items: DataFrame, query: str, key: str, texts: list[str], previous: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The first ``limit`` items by key whose texts contain a query in any case, as ``key, place, outcome``.

    With ``previous`` results (a frame with the key) that aren't empty only these are searched. ``outcome``
    tells a choice from a question: ``one`` if a single item was found, else ``many``; nothing found gives no row.
    """
    found = items.where(F.lower(F.concat_ws(" ", *texts)).contains(query.lower())).select(key).where(F.col(key).isNotNull()).distinct()
    if previous is not None:
        some = previous.select(F.lit(True).alias("__some")).limit(1)
        inside = previous.select(key).distinct().withColumn("__in", F.lit(True))
        found = found.join(F.broadcast(some), how="left").join(inside, key, "left").where("__some is null or __in").select(key)
    top = found.orderBy(key).limit(limit)
    w = Window.orderBy(key)  # of at most ``limit`` rows
    return top.select(key, F.row_number().over(w).alias("place"), F.when(F.count("*").over(Window.partitionBy()) == 1, "one").otherwise("many").alias("outcome"))


#: The words that name a place in the last list, in the order in which they are tried, and the place (-1: the last).
ORDINALS = (("first", 1), ("1st", 1), ("second", 2), ("2nd", 2), ("third", 3), ("3rd", 3), ("last", -1))


def session_references(items: DataFrame, references: DataFrame, key: str = "ref_id", short: int = 6) -> DataFrame:
    """What each reference of a chat session means: ``key, id, rule``.

    ``references`` has ``key, ref, last_item, listed`` (the ids shown last, in order), ``items`` has ``id, label``.
    In this order: ``last`` an empty reference is the session's last item; ``ordinal`` a word for a place in
    the list; ``short id`` the first of the list whose first characters are in the reference; ``label`` the
    whole label; ``part`` a label that contains it; ``candidate`` the id itself (the least id of equals). A
    reference that means nothing has null. Rules on the list look at one row; the others are :func:`resolved`.
    """
    text = F.lower(F.trim("ref"))
    blank = F.coalesce(F.col("ref"), F.lit("")) == ""
    size = F.coalesce(F.size("listed"), F.lit(0))
    ordinal = F.lit(None).cast("string")
    for word, place in reversed(ORDINALS):
        ordinal = F.when(text.contains(word) & (size >= abs(place)), F.try_element_at("listed", F.lit(place))).otherwise(ordinal)
    by_short = F.try_element_at(F.filter("listed", lambda i: text.contains(F.lower(F.left(i, F.lit(short))))), F.lit(1))
    told = references.withColumn("__told", F.when(blank, F.struct(F.col("last_item").alias("id"), F.lit("last").alias("rule")))
        .when(ordinal.isNotNull(), F.struct(ordinal.alias("id"), F.lit("ordinal").alias("rule")))
        .when(by_short.isNotNull(), F.struct(by_short.alias("id"), F.lit("short id").alias("rule"))))
    left = told.where("__told is null").select(key, "ref")
    # A label goes before an id here, and a tail of a label is a part of it.
    known = resolved(items.withColumn("id", F.concat(F.lit("\0"), "id")), left.select(text.alias("ref"))).select(F.col("ref").alias("__r"), F.expr("substring(id, 2)").alias("__id"), F.when(F.col("rule") == 2, "label").otherwise("part").alias("__rule"))
    ids = items.select(F.lower("id").alias("__r"), F.col("id").alias("__same")).groupBy("__r").agg(F.min("__same").alias("__same"))
    searched = left.withColumn("__r", text).join(known, "__r", "left").join(ids, "__r", "left")
    found = searched.select(key, F.coalesce("__id", "__same").alias("id"), F.when(F.col("__id").isNotNull(), F.col("__rule")).when(F.col("__same").isNotNull(), "candidate").otherwise("none").alias("rule"))
    return told.where("__told is not null").select(key, "__told.id", "__told.rule").unionByName(found)
