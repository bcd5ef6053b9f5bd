"""Near-duplicate records: exact set similarity joins with bit-sliced comparison of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.bitslice import close_pairs
from inkweave.llm.codepoints import U, mixed
from inkweave.session import cut, remove, scratch

#: Words and pairs of words are counted in so many slots, by hash: every task has the counts, whatever the collection's size.
SLOTS = 1 << 20
#: Records of a block that one task holds against each other. A word or pair that more records have is extended by a further word;
#: blocks that are larger still are cut into pairs of parts.
BLOCK = 4_096
#: Records of so many distinct words or more are blocked by single words.
LONG = 256
#: Records of one class of equal sets, or part of one, that a task joins with others.
MANY = 1_000
#: Rows that are compared at once.
BATCH = 1 << 15
#: Added to the size of a record in a block in which it doesn't lead.
FOLLOWS = 1 << 30
#: What tells the keys of words, pairs and triples apart.
PLAIN, PAIR, TRIPLE = U(0x5851F42D4C957F2D), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)

GAP = r"[^\p{L}\p{Nd}]+"


def word_set(text: str):
    """The distinct words of a text: longest runs of letters and digits, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), GAP)), "")


def slots(keys: np.ndarray, many: int) -> np.ndarray:
    """The slot of each key's count."""
    return (mixed(keys ^ U(0x9E3779B97F4A7C15)) % U(many)).astype(np.int64)


def plain_sizes(threshold: Fraction, long: int) -> tuple[int, int]:
    """Sets of at most the first size, which may be similar to one that needs less than three common words, and of at least the second,
    which may be similar to one of ``long`` words, go under single words whatever their number."""
    num, den = threshold.numerator, threshold.denominator
    return (2 * den // num + 1) * den // num, -(-long * num // den)


class Prefixes:
    """The first words by rarity of a batch of records, and the keys of their blocks.

    Two sets with a Jaccard similarity of t share, of n words, at least need = ceil(t n), so that their
    rarest, second and third common word are among the first n - need + 1, + 2 and + 3 of each, in any
    order that all records share: here by the count in a word's slot. If the rarest common word is rare (in
    at most :data:`BLOCK` records), both records are in its block; else the two rarest are frequent and
    both are in the pair's block, or, if that pair is in more than :data:`BLOCK` records, in the
    triple's. Words that no other record has need no block. Of two similar sets the smaller one has its rarest
    common words even among its first n - ceil(2 t n / (1 + t)) + 1, + 2 and + 3: only under these it leads, that
    is, is held against larger sets. Long records would have too many pairs,
    and the smallest too few words: they, and those that could be similar to one, are in the block of each
    of their first n - need + 1 words.
    """

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, counts: np.ndarray, threshold: Fraction, long: int) -> None:
        num, den = threshold.numerator, threshold.denominator
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        words = hashes.view(U)
        count = counts[slots(words, len(counts))].astype(np.int64)
        order = np.lexsort((hashes, count, owner))
        self.words, count = words[order], count[order]
        n = np.diff(bounds)
        need = -(-n * num // den)
        small, large = plain_sizes(threshold, long)
        self.first, self.begin = n - need + 1, bounds[:-1]
        self.lead = n + (-2 * n * num // (den + num)) + 1
        place = np.arange(len(hashes)) - bounds[owner]
        inside = place < self.first[owner]
        middle = (need > 2) & (n < long)
        plain = (n >= large) | (n <= small)
        rare = inside & middle[owner] & (count <= RARE) & (count > 0)
        at = inside & plain[owner]
        leads = place < self.lead[owner]
        self.singles = [(owner[rare], mixed(self.words[rare]), leads[rare]), (owner[at], mixed(self.words[at] ^ PLAIN), leads[at])]
        #: Of each record the first frequent word, and the number of frequent ones among its first words.
        frequent = inside & middle[owner] & (count > RARE)
        self.frequent = np.bincount(owner[frequent], minlength=len(n))

    def combined(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Records with equally many frequent words at once: their numbers, the words from the first frequent one on, and the pairs' places in them."""
        for c in np.unique(self.frequent[self.frequent > 0]):
            which = np.flatnonzero(self.frequent == c)
            start = self.begin[which] + self.first[which] - c
            rows = self.words[start[:, None] + np.arange(c + 2)]
            a, b = np.triu_indices(c + 1, 1)
            yield which, rows, a, b

    @staticmethod
    def pair_keys(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(rows[:, a] * PAIR + mixed(rows[:, b]))

    def keys(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of the blocks of each record, as the record's number, the key and whether it leads; ``hot`` tells the slots of pairs that too many records have."""
        owners, keys, leads = ([x[i] for x in self.singles] for i in (0, 1, 2))
        for which, rows, a, b in self.combined():
            pairs = self.pair_keys(rows, a, b)
            many = hot[slots(pairs, len(hot))]
            # The place of a row's first word, from the end of the leading ones.
            before = (self.first - self.lead)[which] - (rows.shape[1] - 2)
            record, pair = np.nonzero(~many)
            leads.append(before[record] + b[pair] < 1)
            owners.append(which[record])
            keys.append(pairs[record, pair])
            record, pair = np.nonzero(many)
            third = b[pair][:, None] + 1 + np.arange(rows.shape[1] - 2)[None]  # every word after the pair's second
            row, step = np.nonzero(third < rows.shape[1])
            words = rows[record[row], third[row, step]]
            owners.append(which[record[row]])
            keys.append(mixed(pairs[record[row], pair[row]] * TRIPLE + mixed(words)))
            leads.append(before[record[row]] + third[row, step] < 2)
        return np.concatenate(owners), np.concatenate(keys), np.concatenate(leads)


#: The greatest rank of a rare word.
RARE = 30_000


def ranked(counts: np.ndarray, block: int) -> np.ndarray:
    """Counts as 16-bit ranks: 0 for one or none, up to :data:`RARE` for those of at most ``block``, above for larger ones."""
    with np.errstate(divide="ignore"):
        scale = np.log2(np.maximum(counts, 1))
    low, high = 1 + np.minimum(scale * 1_000, RARE - 1), RARE + 1 + np.minimum(scale * 500, 65_534 - RARE)
    return np.where(counts < 2, 0, np.where(counts <= block, low, high)).astype(np.uint16)


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Four words a record: the bit of each element's hash is set."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bit = mixed(hashes.view(U) ^ U(0x2545F4914F6CDD1D)) & U(255)
    out = np.zeros((len(bounds) - 1, 4), U)
    np.bitwise_or.at(out, (owner, (bit >> U(6)).astype(np.int64)), U(1) << (bit & U(63)))
    return out


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Some records at a time: their numbers, the hashes of their words, and where each begins."""
    for batch in batches:
        for part in (batch.slice(i, 1_000) for i in range(0, batch.num_rows, 1_000)):
            lists = part.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            hashes = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.int64)
            yield part.column(0), hashes, bounds - bounds[0]


def _counted(hashed: DataFrame, many: int, keys_of: Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]) -> np.ndarray:
    """How many of all records' keys fall into each of ``many`` slots, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many, np.int64)
        for _, hashes, bounds in _lists(batches):
            for keys in keys_of(hashes, bounds):
                at, n = np.unique(slots(keys, many), return_counts=True)
                total[at] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["slot", "n"])

    found = hashed.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(many, np.int64)
    total[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return total


def _keyed(hashed: DataFrame, threshold: Fraction) -> tuple[DataFrame, bool]:
    """Each record under the keys of its blocks: ``key, num, n`` and its sketch; ``n`` is above :data:`FOLLOWS` where it
    doesn't lead. And whether no block can have more than :data:`BLOCK` records: there are only rare words and pairs.
    """
    many, block, long = SLOTS, BLOCK, LONG
    ranks = ranked(_counted(hashed, many, lambda hashes, _: iter([hashes.view(U)])), block)
    hot = np.zeros(many, bool)
    if (ranks > RARE).any():
        pairs = lambda hashes, bounds: (Prefixes.pair_keys(rows, a, b).ravel() for _, rows, a, b in Prefixes(hashes, bounds, ranks, threshold, long).combined())
        hot = _counted(hashed, many, pairs) > block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nums, hashes, bounds in _lists(batches):
            owner, keys, leads = Prefixes(hashes, bounds, ranks, threshold, long).keys(hot)
            marks = sketches(hashes, bounds).view(np.int64)[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), nums.take(pa.array(owner)), pa.array((np.diff(bounds)[owner] | ~leads * FOLLOWS).astype(np.int32)), *(pa.array(np.ascontiguousarray(marks[:, i])) for i in range(4))],
                ["key", "num", "n", "s0", "s1", "s2", "s3"],
            )

    small, large = plain_sizes(threshold, long)
    others = hashed.where((F.size("hashes") <= small) | (F.size("hashes") >= large)).limit(1)
    return hashed.mapInArrow(run, "key long, num long, n int, s0 long, s1 long, s2 long, s3 long"), not hot.any() and others.isEmpty()


def _compared(keyed: DataFrame, keys: list[str], threshold: Fraction) -> DataFrame:
    """Candidate pairs of the blocks under ``keys``, with repeats."""
    top, bottom = threshold.numerator, threshold.denominator

    def pairs(table: pa.Table) -> pa.RecordBatch | None:
        table = table.combine_chunks()
        group = np.zeros(table.num_rows, bool)
        for k in keys:
            value = table.column(k).to_numpy()
            group[1:] |= value[1:] != value[:-1]
        sketch = np.stack([table.column(f"s{i}").to_numpy() for i in range(4)], axis=1).view(U)
        n = table.column("n").to_numpy()
        i, j = close_pairs(np.cumsum(group), n & (FOLLOWS - 1), n < FOLLOWS, sketch, top, bottom)
        if not len(i):
            return None
        num = table.column("num").to_numpy()
        # Within a batch a pair of two blocks comes out once.
        a, b = np.minimum(num[i], num[j]), np.maximum(num[i], num[j])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) & (a < b)
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < BATCH:
                continue
            table = pa.Table.from_batches(held)
            last = np.ones(rows, bool)
            for k in keys:
                value = table.column(k).to_numpy()
                last &= value == value[-1]
            whole = rows - int(last.sum())  # the last block may go on in the next batch
            if whole:
                if (out := pairs(table.slice(0, whole))) is not None:
                    yield out
                held = table.slice(whole).to_batches()
                rows -= whole
        if held and (out := pairs(pa.Table.from_batches(held))) is not None:
            yield out

    columns = [*keys, "num", "n", "s0", "s1", "s2", "s3"]
    return keyed.select(columns).repartition(*keys).sortWithinPartitions(*keys, "n").mapInArrow(run, "a long, b long")


class NearDuplicates:
    """Records with their classes of equal word sets, and the links between classes.

    ``members`` has each record (``rec, rep``), ``links`` each pair of classes (``a, b`` with a < b,
    each named by its least record) whose word sets have a Jaccard similarity of at least
    ``threshold``. Only records of at least ``least`` distinct words are in it.
    """

    def __init__(self, records: DataFrame, threshold: Fraction | str = "0.8", least: int = 1) -> None:
        """``records`` has the columns ``rec`` and ``text``, each rec once."""
        threshold = Fraction(threshold)
        worded = records.where("rec is not null and text is not null").select("rec", word_set("text").alias("words")).where(F.size("words") >= max(least, 1))
        # Words as one text: an array of strings takes three times the room.
        worded = worded.select("rec", F.array_join(F.sort_array("words"), " ").alias("words"))
        worded = cut(worded.withColumn("sum", F.md5(F.col("words").cast("binary"))))
        sets = worded.groupBy("sum").agg(F.min("rec").alias("rep"), F.first("words").alias("words"))
        self.sets = cut(sets.withColumn("num", F.monotonically_increasing_id()))
        self.members = worded.select("rec", "sum").join(self.sets.select("sum", "rep"), "sum").select("rec", "rep")
        self.links = self._links(threshold)

    def _links(self, threshold: Fraction) -> DataFrame:
        spark, sets = self.sets.sparkSession, self.sets
        keyed, bounded = _keyed(sets.select("num", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("hashes")), threshold)
        path = scratch(spark, "blocks")
        if not bounded:
            keyed.write.parquet(path)
            keyed = spark.read.parquet(path)
            hot = cut(keyed.groupBy("key").count().where(F.col("count") > BLOCK))
            bounded = hot.isEmpty()
        found = _compared(keyed if bounded else keyed.join(hot.select("key"), "key", "left_anti"), ["key"], threshold)
        if not bounded:
            # A larger block is cut into parts by the record; each pair of parts is a block by itself.
            parts = F.ceil(F.col("count") / BLOCK).cast("int")
            split = keyed.join(hot, "key").withColumn("mine", F.pmod(F.xxhash64("num"), parts).cast("int"))
            split = split.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            split = split.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
            found = found.unionByName(_compared(split, ["key", "i", "j"], threshold))
        found = cut(found.distinct())
        remove(spark, path)
        a, b = (sets.select(F.col("num").alias(x), F.col("rep").alias(f"{x}_rep"), F.col("words").alias(f"{x}_words")) for x in "ab")
        words = lambda c: F.split(c, " ")
        both = F.size(F.array_intersect(words("a_words"), words("b_words")))
        union = F.size(words("a_words")) + F.size(words("b_words")) - both
        near = found.join(a, "a").join(b, "b").where(both * threshold.denominator >= union * threshold.numerator)
        return cut(near.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")))

    def classes(self) -> DataFrame:
        """One row for each record: ``rec``, its class and the number of other classes linked to it."""
        ends = self.links.select(F.col("a").alias("rep")).unionAll(self.links.select(F.col("b").alias("rep")))
        degree = ends.groupBy("rep").agg(F.count("*").alias("links"))
        return self.members.join(degree, "rep", "left").select("rec", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))

    def pairs(self) -> DataFrame:
        """Every pair of records, ``rec_a < rec_b``: of linked classes and of one class.

        There are as many as pairs: where a class may hold most records, :meth:`classes` says the same in one
        row a record. A class of more than :data:`MANY` records is cut into parts, so that its pairs are made in many tasks.
        """
        members = self.members
        large = cut(members.groupBy("rep").count().where(F.col("count") > MANY).select("rep", F.ceil(F.col("count") / MANY).cast("int").alias("parts")))
        if large.isEmpty():
            x = members.select(F.col("rec").alias("x"), F.col("rep").alias("a"), F.lit(0).alias("p"))
            y = members.select(F.col("rec").alias("y"), F.col("rep").alias("b"), F.lit(0).alias("q"))
            ends = self.links.select("a", "b", F.lit(0).alias("p"), F.lit(0).alias("q"))
            twins = self.members.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("p"), F.lit(0).alias("q"))
        else:
            split = members.join(large, "rep", "left").select("rec", "rep", F.coalesce(F.pmod(F.xxhash64("rec"), "parts"), F.lit(0)).cast("int").alias("part"))
            x, y = (split.select(F.col("rec").alias(r), F.col("rep").alias(c), F.col("part").alias(n)) for r, c, n in (("x", "a", "p"), ("y", "b", "q")))
            parts = lambda df, c, n: df.join(large.select(F.col("rep").alias(c), F.col("parts").alias("__parts")), c, "left").withColumn(n, F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
            ends = parts(parts(self.links.select("a", "b"), "a", "p"), "b", "q")
            twins = parts(parts(members.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")), "a", "p"), "b", "q")
        across = ends.join(x, ["a", "p"]).join(y, ["b", "q"]).select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))
        same = twins.join(x, ["a", "p"]).join(y, ["b", "q"]).where("x < y").select(F.col("x").alias("rec_a"), F.col("y").alias("rec_b"))
        return across.unionByName(same)


def near_duplicates(records: DataFrame, rec: str, text: str, threshold: Fraction | str = "0.8", least: int = 1) -> NearDuplicates:
    """Similar records of a table, by the Jaccard similarity of their sets of words.

    Method: bit-sliced comparison. Each set is sketched in 256 bits; records that share a rare word,
    or a pair or triple of frequent ones, form a block (see :class:`Prefixes`: no similar pair is missed); a
    block's sketches are stored as bit planes, distances are counted by carry-save adders for 64
    records in a word, and words in which all are beyond the radius are abandoned. What is left is
    verified on the words themselves.
    Null keys or texts and texts of fewer than ``least`` words: not in the result. A key that comes
    several times counts once, with its greatest text. Equal sets are one class and are compared once.
    """
    once = records.select(F.col(rec).cast("string").alias("rec"), F.col(text).cast("string").alias("text")).groupBy("rec").agg(F.max("text").alias("text"))
    return NearDuplicates(once, threshold, least)
