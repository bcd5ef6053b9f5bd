"""Evaluation items whose passages occur in a training corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkweave.llm.codepoints import Spans, U, codes, gathered, mixed
from inkweave.session import cut

#: Words are counted in so many slots, by hash, and the items' words and windows are known to the tasks as filters
#: of so many bits: their size is the same for any number of items.
SLOTS, BITS = 1 << 20, 1 << 22

_WORDY: list[np.ndarray] = []


def wordy() -> np.ndarray:
    """For each code point whether it is a letter or a digit."""
    if not _WORDY:
        import unicodedata

        flags = np.fromiter(((k[0] == "L" or k == "Nd") for k in map(unicodedata.category, map(chr, range(0x110000)))), bool, 0x110000)
        _WORDY.append(flags)
    return _WORDY[0]


class Words:
    """The words of many texts: longest runs of letters and digits of the lower-cased text."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = [t.lower() for t in texts]
        self.points, bounds = codes(self.texts)
        inside = np.zeros(len(self.points) + 1, bool)
        inside[:-1] = wordy()[self.points]
        edge = inside.copy()
        edge[1:] ^= inside[:-1]
        edge[bounds[:-1]] = inside[bounds[:-1]]  # a text's first character begins a word even if the one before it is wordy
        last = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        cuts = bounds[1:-1]
        joined = np.unique(cuts[inside[cuts - 1] & inside[cuts]])
        self.start = np.flatnonzero(edge & inside)
        self.end = np.sort(np.concatenate([last, joined]))
        self.bounds = bounds
        self.owner = np.searchsorted(bounds, self.start, "right") - 1
        self.hash = Spans(self.points.astype(U)).hash(self.start, self.end) if len(self.start) else np.empty(0, U)

    def joined(self, first: int, count: int) -> str:
        """Words in a row, of one text, with blanks between."""
        at = self.bounds[self.owner[first]]
        text = self.texts[self.owner[first]]
        return " ".join([text[s - at : e - at] for s, e in zip(self.start[first : first + count].tolist(), self.end[first : first + count].tolist())])


def _slots(texts: list[str], slots: int) -> np.ndarray:
    return (Words(texts).hash % U(slots)).astype(np.int64)


def _ranks(corpus: DataFrame, items: DataFrame, slots: int) -> np.ndarray:
    """How frequent the items' words are in the corpus, by slot: counted by one pass, added up in the tasks first."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(slots, bool)
        for batch in batches:
            for _, texts in gathered((None, t) for t in batch.column(0).to_pylist()):
                seen[_slots(texts, slots)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["slot"])

    known = np.zeros(slots, bool)
    known[items.select("t").mapInArrow(listed, "slot int").distinct().toArrow().column("slot").to_numpy()] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for _, texts in gathered((None, t) for t in batch.column(0).to_pylist()):
                found = _slots(texts, slots)
                at, n = np.unique(found[known[found]], return_counts=True)
                total[at] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["slot", "n"])

    found = corpus.select("t").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(slots, np.int64)
    total[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(np.log2(total + 1) * 1_000, 65_535).astype(U)


def _token(word: np.ndarray, offset: np.ndarray | int) -> np.ndarray:
    """A prefix word together with its place in the window."""
    return mixed(word ^ (np.asarray(offset).astype(U) + U(1)) * U(0x9E3779B97F4A7C15))


class Filter:
    """A set of hashes as bits (a power of two of them), with false positives."""

    def __init__(self, bits: int) -> None:
        self.bits, self.words = bits, np.zeros(-(-bits // 64), U)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & U(self.bits - 1)
        return (self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) != 0


def _windows(items: DataFrame, width: int, ranks: np.ndarray, kind: T.DataType) -> DataFrame:
    """The windows of each item: ``h, words, item``, and the hashes of the prefix word and of it with its place.

    The windows of a text that must be contained whole have a prefix of one word: the rarest one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrow = batch.schema.field(0).type
            for keys, texts in gathered(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                words = Words(texts)
                if len(words.hash) < width:
                    continue
                first = np.arange(len(words.hash) - width + 1)
                first = first[words.owner[first] == words.owner[first + width - 1]]
                if not len(first):
                    continue
                order = ranks[(words.hash % U(len(ranks))).astype(np.int64)] << U(48) | words.hash >> U(16)
                offset = np.lib.stride_tricks.sliding_window_view(order, width)[first].argmin(axis=1)
                rarest = words.hash[first + offset]
                columns = (Spans(words.hash).hash(first, first + width), rarest, _token(rarest, offset))
                h, word, token = (pa.array(c.view(np.int64)) for c in columns)
                texts_ = pa.array([words.joined(i, width) for i in first.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([h, texts_, pa.array(keys, arrow).take(pa.array(words.owner[first])), word, token], ["h", "words", "item", "word", "token"])

    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("words", T.StringType()), T.StructField("item", kind), T.StructField("word", T.LongType()), T.StructField("token", T.LongType())])
    return items.mapInArrow(run, schema).distinct()


def _filters(windows: DataFrame, bits: int) -> list[Filter]:
    """Filters of the prefix words, of these with their places, and of the windows: at most bits / 64 words each."""
    kinds = ["word", "token", "h"]
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(c).bitwiseAND(F.lit(bits - 1)).cast("int").alias("bit")) for i, c in enumerate(kinds))))
    masks = windows.select(at.alias("x")).select("x.kind", F.shiftright("x.bit", 6).alias("word"), F.expr("shiftleft(1L, x.bit & 63)").alias("mask"))
    found = masks.groupBy("kind", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = [Filter(bits) for _ in kinds]
    kind, word, mask = (found.column(c).to_numpy() for c in ("kind", "word", "mask"))
    for i, one in enumerate(out):
        one.words[word[kind == i]] = mask[kind == i].astype(np.int64).view(U)
    return out


def leaked_items(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """The pairs of a row of ``df`` and an item that have ``width`` consecutive words in common.

    Method: prefix-filtered join of word windows. The items' words are counted over the whole corpus; each window
    of an item goes under its rarest word. A pass over the corpus looks at the places of those words
    only, bounds them by position in the window and in the text, and keeps windows whose hash an item may
    have; they are joined with the items' windows by hash, and their words compared.
    The corpus is read twice, whatever the number of items, and never shuffled; what the tasks hold
    (counts by slot, filters) has a fixed size. Items are never gathered in one place.
    Null keys or texts, empty texts and texts of fewer than ``width`` words: no rows. Repeated rows of
    one key or item: each pair once. An empty table: no rows.
    """
    names = (key, item_key) if key != item_key else (key, "item")
    corpus = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")
    wanted = items.select(F.col(item_key).alias("k"), F.col(item_text).cast("string").alias("t")).where("k is not null and t is not null")
    windows = cut(_windows(wanted, width, _ranks(corpus, wanted, SLOTS), items.schema[item_key].dataType))
    prefix, tokens, whole = _filters(windows, BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrow = batch.schema.field(0).type
            for keys, texts in gathered(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                words = Words(texts)
                hits = np.flatnonzero(prefix.has(words.hash))
                if len(words.hash) < width or not len(hits):
                    continue
                places = []
                for offset in range(width):
                    first = hits[tokens.has(_token(words.hash[hits], offset))] - offset
                    places.append(first[(first >= 0) & (first + width <= len(words.hash))])
                first = np.unique(np.concatenate(places))
                # Positional bound: the window must begin and end in one text.
                first = first[words.owner[first] == words.owner[first + width - 1]]
                sums = Spans(words.hash).hash(first, first + width)
                near = whole.has(sums)
                first, sums, owner = first[near], sums[near], words.owner[first[near]]
                if not len(first):
                    continue
                _, once = np.unique(np.stack([owner.astype(U), sums]), axis=1, return_index=True)
                found = pa.array([words.joined(i, width) for i in first[once].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(keys, arrow).take(pa.array(owner[once])), pa.array(sums[once].view(np.int64)), found], ["k", "h", "found"])

    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField("found", T.StringType())])
    found = corpus.mapInArrow(run, schema).join(windows.select("h", "words", "item"), "h").where(F.col("found") == F.col("words"))
    return found.select(F.col("k").alias(names[0]), F.col("item").alias(names[1])).distinct()
