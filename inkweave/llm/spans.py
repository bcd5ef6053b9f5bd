"""Long exact spans shared between records, over a log-structured index of window fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkweave.llm.codepoints import Spans, U, codes, gathered, sliding_min
from inkweave.session import cut, remove, scratch

#: Bits of the filter that tells which documents' texts are needed: it is broadcast, and has this size for any number of them.
BITS = 1 << 22
#: Distinct surroundings of one fingerprint that a task compares by itself; larger groups are compared by a shuffle.
LOCAL = 2_000


def anchors(texts: list[str], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The windows of ``length`` characters of each text, gathered by their least gram.

    A window's anchor is the place of the least hash among its grams of ``gram`` characters, the
    leftmost of equals. It depends on nothing but the window's characters, so equal windows have
    equal anchors, and neighbouring windows mostly share theirs. Returns for each run of windows with
    one anchor: the text's number, the gram's hash, the hash of the run's whole text, and the places
    of its first window, its anchor and its last window in the text.
    """
    points, bounds = codes(texts)
    empty = np.empty(0, np.int64)
    if len(points) < length:
        return empty, empty, empty, empty, empty, empty
    spans = Spans(points.astype(U))
    bits = U(int(len(points)).bit_length())
    grams = spans.every(gram)
    least = sliding_min((grams >> bits << bits) | np.arange(len(grams), dtype=U), length - gram + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[: len(least)]
    first = np.flatnonzero(np.arange(len(least)) + length <= bounds[owner + 1])
    if not len(first):
        return empty, empty, empty, empty, empty, empty
    place = (least[first] & ((U(1) << bits) - U(1))).astype(np.int64)
    owner = owner[first]
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(first)) - 1
    low, high, place, owner = first[begins], first[ends], place[begins], owner[begins]
    start = bounds[owner]
    return owner, grams[place].view(np.int64), spans.hash(low, high + length).view(np.int64), low - start, place - start, high - start


def fingerprints(df: DataFrame, length: int, gram: int) -> DataFrame:
    """From ``doc`` and ``text`` the rows ``fp, around, doc, low, at, high`` of every text, without a shuffle."""
    doc = df.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            rows = ((k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(t) >= length)
            for keys, texts in gathered(rows):
                owner, fp, around, low, at, high = anchors(texts, length, gram)
                # A place in the run needs few bits: first window, and from it the anchor and the last window.
                place = low << 32 | (at - low) << 16 | (high - low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp), pa.array(around), pa.array(keys, arrow).take(pa.array(owner)), pa.array(place)], ["fp", "around", "doc", "place"]
                )

    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("around", T.LongType()), T.StructField("doc", doc), T.StructField("place", T.LongType())])
    return df.select("doc", "text").where(F.col("doc").isNotNull() & (F.char_length("text") >= length)).mapInArrow(run, schema)


def reach(group: Iterable[tuple[object, bool, str, int, int]], length: int) -> list[tuple[int, int] | None]:
    """Of one fingerprint's distinct surroundings: the first and last window of each that another
    document has, in windows from its first.

    Each is ``(doc, many, text, before, windows)``: ``many`` if several documents have these
    surroundings, ``before`` the characters before the anchor, ``windows`` their number. Windows are
    compared as strings at the same distance from the anchor.
    """
    group = list(group)
    seen: dict[tuple[int, str], object] = {}
    several = object()
    for doc, many, text, before, windows in group:
        for i in range(windows):
            key = (i - before, text[i : i + length])
            had = seen.setdefault(key, several if many else doc)
            if had is not several and (many or had != doc):
                seen[key] = several
    out: list[tuple[int, int] | None] = []
    for _doc, _many, text, before, windows in group:
        found = [i for i in range(windows) if seen[(i - before, text[i : i + length])] is several]
        out.append((found[0], found[-1]) if found else None)
    return out


class SpanIndex:
    """Sorted immutable runs of window fingerprints in the shared folder, in levels, and the windows' postings.

    A run has one row for each fingerprint, with its least and greatest document: it is added up in the
    tasks before it is shuffled, so that a fingerprint that a third of all windows have does no harm. Runs
    are bucketed and sorted by fingerprint, all in the same number of buckets, so that they are
    merge-joined bucket by bucket without being shuffled: a batch shuffles its own fingerprints only,
    however long the history. ``append`` writes a batch's run and joins it with each run there is, which
    gives the fingerprints now known to be in more than one document. Where a level has ``fan`` runs,
    they are merged into one of the next level, so that there are never more than about fan times the
    logarithm of the number of batches. Postings are written once, as they come. ``report`` verifies
    character for character and counts. Whether documents come in one batch or in many, the counts are the same.
    """

    def __init__(self, spark: SparkSession, length: int = 200, gram: int | None = None, path: str | None = None, fan: int = 4, buckets: int | None = None) -> None:
        if not 1 <= length <= 65_535:
            raise ValueError("spans have 1 to 65,535 characters")
        self.spark, self.length, self.gram = spark, length, gram or max(1, length * 8 // 25)
        self.path, self.fan = path or scratch(spark, "spans"), max(fan, 2)
        self.buckets = buckets or max(8, 2 * spark.sparkContext.defaultParallelism)
        #: The tables of runs and of shared fingerprints, each with its level; those of shared ones have none in common.
        self.postings: list[str] = []
        self.runs: list[tuple[int, str]] = []
        self.shared: list[tuple[int, str]] = []
        self.written = 0

    def _write(self, rows: DataFrame, kind: str, level: int) -> tuple[int, str]:
        """Writes rows as a table in buckets; a shuffle by fingerprint on the way makes just these."""
        name = f"{kind}_{self.path.rsplit('/', 1)[-1].replace('-', '_')}_{self.written}"
        setting = "spark.sql.shuffle.partitions"
        had = self.spark.conf.get(setting)
        self.spark.conf.set(setting, str(self.buckets))
        try:
            rows.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/{kind}-{self.written:05d}").format("parquet").saveAsTable(name)
        finally:
            self.spark.conf.set(setting, had)
        self.written += 1
        return level, name

    def drop(self, tables: Iterable[tuple[int, str]] | None = None) -> None:
        """Deletes tables with their files; without any given, the whole index."""
        for _, name in tables if tables is not None else [*self.runs, *self.shared]:
            where = f"{self.path}/{name.split('_', 1)[0]}-{int(name.rsplit('_', 1)[1]):05d}"
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, where)
        if tables is None:
            remove(self.spark, self.path)

    def append(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> SpanIndex:
        """Add a batch of new documents; rows with a null key or text have no spans."""
        docs = df.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
        postings = f"{self.path}/postings-{self.written:05d}"
        fingerprints(docs, self.length, self.gram).write.parquet(postings)
        self.postings.append(postings)
        run = self._write(self.spark.read.parquet(postings).groupBy("fp").agg(F.min("doc").alias("least"), F.max("doc").alias("most")), "run", 0)
        now = self.spark.table(run[1])
        found = now.where("least < most").select("fp")
        for _, old in self.runs:
            both = now.join(self.spark.table(old).select("fp", F.col("least").alias("l"), F.col("most").alias("m")), "fp")
            found = found.unionByName(both.where(F.least("least", "l") < F.greatest("most", "m")).select("fp"))
        for _, name in self.shared:
            found = found.join(self.spark.table(name), "fp", "left_anti")
        self.shared.append(self._write(found.distinct(), "shared", 0))
        self.runs.append(run)
        for tables in (self.runs, self.shared):
            while (level := next((at for at, _ in tables if sum(x == at for x, _ in tables) >= self.fan), None)) is not None:
                self._merge(tables, [t for t in tables if t[0] == level], level + 1)
        return self

    def _merge(self, tables: list[tuple[int, str]], old: list[tuple[int, str]], level: int) -> None:
        """Merge tables into one, two at a time and bucket by bucket: nothing is shuffled."""
        kind, merged = "run" if tables is self.runs else "shared", old[0]
        for other in old[1:]:
            a, b = (self.spark.table(name) for _, name in (merged, other))
            if kind == "run":
                b = b.select("fp", F.col("least").alias("l"), F.col("most").alias("m"))
                rows = a.join(b, "fp", "full_outer").select("fp", F.least("least", "l").alias("least"), F.greatest("most", "m").alias("most"))
            else:
                rows = a.join(b, "fp", "full_outer")
            written = self._write(rows, kind, level)
            self.drop([merged, other])
            merged = written
        tables[:] = [t for t in tables if t not in old] + [merged]

    def compact(self) -> SpanIndex:
        """Merge all runs into one."""
        for tables in (self.runs, self.shared):
            if len(tables) > 1:
                self._merge(tables, [*tables], 1 + max(level for level, _ in tables))
        return self

    @staticmethod
    def _having(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
        """The rows whose value of a column is among those wanted, and few others: by a filter of :data:`BITS` bits, which is broadcast."""
        bit = F.xxhash64(column).bitwiseAND(F.lit(BITS - 1))
        masks = wanted.select(column).select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.expr("1L"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("mask"))
        masks = masks.groupBy("word").agg(F.bit_or("mask").alias("mask"))
        found = rows.withColumns({"bit": bit, "word": F.shiftright(bit, 6)}).join(F.broadcast(masks), "word")
        return found.where(F.call_function("shiftrightunsigned", "mask", F.col("bit").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1).select(rows.columns)

    def _reached(self, classes: DataFrame) -> DataFrame:
        """For surroundings that only one document has, the windows that occur elsewhere: ``fp, around, start, stop``."""
        length = self.length
        groups = cut(classes.groupBy("fp").agg(F.count("*").alias("n"), F.max(~F.col("many")).alias("open")).where("open and n > 1"))
        texts = self._having(classes, "fp", groups).join(groups, "fp").select("fp", "around", "many", "n", "doc", "before", "windows", "piece")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for batch in batches:
                    yield from zip(*(c.to_pylist() for c in batch.columns))

            def result(group: list[tuple]) -> list[tuple]:
                found = reach((g[2:] for g in group), length)
                return [(g[0], g[1], *f) for g, f in zip(group, found) if f and not g[3]]

            out, group = [], []
            for row in rows():
                if group and group[0][0] != row[0]:
                    out += result(group)
                    group = []
                group.append(row)
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
                    out = []
            out += result(group) if group else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

        names, kinds = ["fp", "around", "start", "stop"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        local = (
            texts.where(F.col("n") <= LOCAL).select("fp", "around", "doc", "many", "piece", "before", "windows")
            .repartition("fp").sortWithinPartitions("fp").mapInArrow(run, "fp long, around long, start int, stop int")
        )
        # Fingerprints with very many surroundings: every window is a row, so no task holds a group.
        window = (
            texts.where(F.col("n") > LOCAL)
            .select("fp", "around", "doc", "many", "before", "piece", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("i"))
            .select("fp", "around", "doc", "many", "i", (F.col("i") - F.col("before")).alias("offset"), F.md5(F.substring("piece", F.col("i") + 1, F.lit(length)).cast("binary")).alias("sum"))
        )
        multiple = window.groupBy("fp", "offset", "sum").agg(F.max("many").alias("many"), F.min("doc").alias("least"), F.max("doc").alias("most")).where("many or least < most")
        wide = (
            window.where("not many").join(multiple.select("fp", "offset", "sum"), ["fp", "offset", "sum"], "left_semi")
            .groupBy("fp", "around").agg(F.min("i").alias("start"), F.max("i").alias("stop"))
        )
        return local.unionByName(wide)

    def report(self, df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "shared_chars") -> DataFrame:
        """The key of each document that shares a window, and the number of its characters in shared windows.

        ``df`` has the texts of the indexed documents. All windows of one anchor hold the anchor, so
        those of them that are shared cover everything from the first one's start to the last one's end.
        Surroundings are the same where all their characters are: documents are grouped by them, not by a hash.
        """
        docs = df.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
        known = reduce(DataFrame.unionByName, (self.spark.table(name) for _, name in self.shared))
        rows = cut(self._having(self.spark.read.parquet(*self.postings), "fp", known).join(known, "fp", "left_semi"))
        low, before, windows = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(0xFFFF), F.col("place").bitwiseAND(0xFFFF) + 1
        placed = rows.select("fp", "around", "doc", low.alias("low"), before.cast("int").alias("before"), windows.cast("int").alias("windows"))
        piece = F.substring("text", (F.col("low") + 1).cast("int"), F.col("windows") + (self.length - 1))
        pieces = placed.join(self._having(docs, "doc", rows), "doc").select("fp", "around", "doc", "low", "before", "windows", piece.alias("piece"))
        grouped = ["fp", "around", "before", "windows", "piece"]
        classes = cut(pieces.groupBy(*grouped).agg(F.min("doc").alias("doc"), (F.min("doc") < F.max("doc")).alias("many")))
        # Surroundings that differ under one hash are told apart by their characters from here on; there are hardly ever any.
        twins = cut(classes.groupBy("fp", "around").count().where("count > 1").select("fp", "around"))
        numbered = None
        if not twins.isEmpty():
            numbers = classes.join(twins, ["fp", "around"], "left_semi").select(*grouped, F.concat_ws(" ", "before", "windows", F.md5(F.col("piece").cast("binary"))).alias("number"))
            classes = classes.join(numbers, grouped, "left")
            numbered = pieces.join(twins, ["fp", "around"], "left_semi").join(numbers, grouped)
            alone = placed.join(twins, ["fp", "around"], "left_anti").withColumn("number", F.lit(None).cast("string"))
            placed = alone.unionByName(numbered.select(*alone.columns))
            classes = cut(classes.withColumn("around", F.when(F.col("number").isNull(), F.col("around")).otherwise(F.xxhash64("around", "number"))))
            placed = placed.withColumn("around", F.when(F.col("number").isNull(), F.col("around")).otherwise(F.xxhash64("around", "number")))
        whole = classes.where("many").select("fp", "around", F.lit(0).alias("start"), F.lit(None).cast("int").alias("stop"))
        ranges = whole.unionByName(self._reached(classes))
        spans = placed.join(ranges, ["fp", "around"]).select(
            "doc", (F.col("low") + F.col("start")).alias("s"), (F.col("low") + F.coalesce("stop", F.col("windows") - 1) + self.length).alias("e")
        )
        before_ = Window.partitionBy("doc").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        new = F.col("e") - F.greatest("s", F.coalesce(F.max("e").over(before_), F.lit(0).cast("long")))
        return (
            spans.groupBy("doc", "s").agg(F.max("e").alias("e")).select("doc", F.greatest(new, F.lit(0).cast("long")).alias("n"))
            .groupBy("doc").agg(F.sum("n").alias(name)).select(F.col("doc").alias(key), name)
        )


def arrivals(df: DataFrame, at: str | None, batches: int) -> list[DataFrame]:
    """A table in batches by equal parts of the time between its first and last arrival; rows without a time come first."""
    if at is None or batches < 2:
        return [df]
    when = F.unix_micros(F.col(at).cast("timestamp"))
    first, last = df.agg(F.min(when), F.max(when)).first()
    if first is None or first == last:
        return [df]
    edges = [first + (last - first) * i // batches for i in range(1, batches)]
    batch = F.coalesce(sum(((when > e).cast("int") for e in edges), F.lit(0)), F.lit(0))
    return [df.where(batch == i) for i in range(batches)]


def shared_spans(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, name: str = "shared_chars", at: str | None = None, batches: int = 2, fan: int = 2, path: str | None = None
) -> DataFrame:
    """For each record the number of its characters in a span of ``length`` that another record has too.

    Method: a log-structured index of window fingerprints (:class:`SpanIndex`), fed with the records in
    ``batches`` by their time of arrival ``at`` (without one: all at once), and compacted in levels of
    ``fan`` runs. Each window is indexed by its anchor, a gram chosen by content alone, so nothing is missed;
    candidates are verified on the characters themselves. With a ``path`` the index is kept there.
    Null keys, null, empty and short texts: no row. Repeated rows of one key are one record: its spans
    don't count as another's. Copies: all their characters count. An empty table: no rows.
    """
    index = SpanIndex(df.sparkSession, length, path=path, fan=fan)
    for batch in arrivals(df, at, batches):
        index.append(batch, key, text)
    found = index.report(df, key, text, name)
    if path is None:
        found = cut(found)
        index.drop()
    return found
