"""Transcripts: token frequencies, rare tokens, locating quotes and contexts, aligning clips."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from functools import cache, lru_cache
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.functions.text import common_subsequence, plain_letters, sequence_ratio, tokens

#: What a context needs to match a transcript.
STARTS, LEAST_CHARS, STRONG, WEAK, WEAK_WORDS = (12, 10, 8, 6), 15, 0.6, 0.4, 3


def token_frequency(df: DataFrame, text: str) -> DataFrame:
    """How often each token of cleaned texts occurs; upper and lower case differ."""
    return df.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def rare_tokens(contexts: DataFrame, key: str, text: str, frequency: DataFrame, rarity: int = 2, least: int = 4) -> DataFrame:
    """The tokens of each context, repeats kept, that are at least four long and occur at most twice (0 when unseen), ranked by frequency, then length."""
    from pyspark.sql import Window

    listed = contexts.select(key, F.posexplode(tokens(text)).alias("position", "token")).where(F.char_length("token") >= least)
    counted = listed.join(frequency, "token", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where(F.col("n") <= rarity)
    order = Window.partitionBy(key).orderBy("n", F.desc(F.char_length("token")), "position")
    return counted.select(key, "position", "token", "n", F.row_number().over(order).alias("rank"))


def _by_recording(
    words: DataFrame, members: list[str], asked: DataFrame, wanted: list[str], schema: str, answers: Callable[[list[tuple], list[tuple]], Iterable[tuple]]
) -> DataFrame:
    """What ``answers`` gives for each recording's rows of ``words`` (in the order of ``idx``) and of ``asked``: rows ``rec_id`` and then as in ``schema``.

    A recording's rows are one array: it is as long as one recording, however many there are. The arrays are few rows that take
    long, so they are spread over as many tasks as the session has for shuffles.
    """
    # Spread before they are grouped, the rows are shuffled once; a shuffle that Spark itself adds would be merged into few tasks.
    spread = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rec_id")
    said = spread(words.select("rec_id", "idx", *members)).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("idx", *members))).alias("said"))
    rows = spread(asked.select("rec_id", *wanted)).groupBy("rec_id").agg(F.collect_list(F.struct(*wanted)).alias("asked")).join(said, "rec_id", "left")
    rows = rows.select("rec_id", "said", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                keys, out = [], []
                said_of, asked_of = (lists_of(part.column(i), names) for i, names in ((1, members), (2, wanted)))
                for n, key in enumerate(part.column(0).to_pylist()):
                    for row in answers(said_of(n), asked_of(n)):
                        keys.append(key)
                        out.append(row)
                if out:
                    columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, part.schema.field(0).type), *columns], ["rec_id", *names_out])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    kinds, names_out = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]
    return rows.mapInArrow(run, f"rec_id {rows.schema['rec_id'].dataType.simpleString()}, {schema}")


def lists_of(column: pa.ListArray, names: list[str]) -> Callable[[int], list[tuple]]:
    """The rows of each list of structs, as tuples of some members."""
    first = column.offsets[0].as_py() if len(column) else 0
    ends = [0 if e is None else e - first for e in column.offsets.to_pylist()]
    values = column.values.slice(first)
    members = [values.field(n).to_pylist() for n in names]
    return lambda n: list(zip(*(m[ends[n] : ends[n + 1]] for m in members)))


def _normal(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", "", text.lower()).split())


def _equal_span(words: list[tuple[str, float, float]], plain: list[str], wanted: str, most_ms: float) -> tuple[float, float, float] | None:
    """The first span that is the target itself: no other scores 100, so none need be scored."""
    for i in range(len(words)):
        size = 0
        for j in range(i, len(words)):
            added = plain[j] if not size or not plain[j] else f" {plain[j]}"
            if not wanted.startswith(added, size):
                break
            size += len(added)
            if size == len(wanted) and (words[j][2] - words[i][1]) * 1000 <= (j - i + 1) * most_ms:
                return words[i][1], words[j][2], 100.0
    return None


def best_span(
    words: list[tuple[str, float, float]], target: str, least: float = 70.0, most_ms: float = 1_500.0, plain: list[str] | None = None
) -> tuple[float, float, float] | None:
    """The start, end and score of the words in a row that are most like a target, the first of equals.

    Scores are :func:`edit_ratio`, carried on from one word to the next. A score of ``least`` needs 2 min(a, b) / (a + b) >= least / 100, so only spans whose length is within
    that bound of the target's are compared; the bound loses nothing. ``plain`` are the words as :func:`_normal` has them, if known.
    """
    wanted = _normal(target)
    if not wanted:
        return None
    plain = [_normal(w[0]) for w in words] if plain is None else plain
    if least <= 100 and (exact := _equal_span(words, plain, wanted, most_ms)):
        return exact
    ratio = least / 100
    shortest, longest = ceil(len(wanted) * ratio / (2 - ratio)), len(wanted) * (2 - ratio) / ratio
    masks: dict[str, int] = {}
    for i, c in enumerate(wanted):
        masks[c] = masks.get(c, 0) | 1 << i
    full, best = (1 << len(wanted)) - 1, None
    for i in range(len(words)):
        row, size = full, 0  # of the words so far: the subsequence's bits, the length
        for j in range(i, len(words)):
            added = plain[j] if not size or not plain[j] else f" {plain[j]}"
            size += len(added)
            if size > longest:
                break
            for c in added:
                hit = row & masks.get(c, 0)
                row = (row + hit | row - hit) & full
            if size < shortest or (words[j][2] - words[i][1]) * 1000 > (j - i + 1) * most_ms:
                continue
            score = 200.0 * (len(wanted) - row.bit_count()) / (size + len(wanted))
            if score >= least and (best is None or score > best[2]):
                best = (words[i][1], words[j][2], score)
    return best


def locate_quotes(words: DataFrame, quotes: DataFrame, least: float = 70.0) -> DataFrame:
    """Where each quote is said: ``rec_id, quote_id, start, end, score``, nulls where nowhere.

    ``words`` has ``rec_id, idx, text, start, end``, ``quotes`` has ``rec_id, quote_id, quote``. A
    recording's words are one group: it is as long as one recording, however many there are.
    """

    def answers(said: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
        rows = [(t or "", start, end) for t, start, end in said]
        plain = [_normal(t) for t, _, _ in rows]
        for number, quote in asked:
            yield (number, *(best_span(rows, quote or "", least, plain=plain) or (None, None, None)))

    schema = f"quote_id {quotes.schema['quote_id'].dataType.simpleString()}, start double, end double, score double"
    return _by_recording(words, ["text", "start", "end"], quotes, ["quote_id", "quote"], schema, answers)


#: Short texts are their own windows, so that the same two are asked for several times in a row.
_ratio = lru_cache(64)(sequence_ratio)


def anchor_match(candidate: str, anchor: str, window: int) -> tuple[float, int]:
    """The best likeness of an anchor to a window of a candidate and where it begins; (0, -1) if none has any."""
    if len(candidate) < window:
        return _ratio(candidate, anchor), 0
    wanted = plain_letters(anchor)
    matcher, best = SequenceMatcher(None, "", wanted), (0.0, -1)
    for i in range(len(candidate) - window + 1):
        said = plain_letters(candidate[i : i + window])
        # The longest common subsequence bounds the likeness, and is far quicker found.
        size = len(wanted) + len(said)
        if not size or 2.0 * common_subsequence(wanted, said) / size > best[0]:
            matcher.set_seq1(said)
            if (score := matcher.ratio()) > best[0]:
                best = (score, i)
    return best


def edge_action(edge: float, anchored: float, delta: float = 0.15) -> str:
    """What to do with an end of a clip: its own likeness against the best one anywhere."""
    return "contract" if edge - anchored < -delta else "extend" if edge - anchored > delta else "ok"


def judged(candidate: str, target: str, window: int = 80, delta: float = 0.1) -> dict:
    """How like a clip's text is to its target: overall, at both ends, and what to do with each end."""
    head, tail = target[:window], target[-window:]
    first, last = _ratio(candidate[:window], head), _ratio(candidate[-window:], tail)
    best_first, best_last = anchor_match(candidate, head, window)[0], anchor_match(candidate, tail, window)[0]
    return {
        "overall": _ratio(candidate, target), "start_score": first, "end_score": last, "start_best": best_first, "end_best": best_last,
        "start_action": edge_action(first, best_first, delta), "end_action": edge_action(last, best_last, delta),
    }


def aligned(
    words: list[tuple[str, int, int]], target: str, start: int, end: int, rounds: int = 20, window: int = 200, step: int = 1_500, share: float = 0.05, shortest: float = 0.8, longest: float = 1.2
) -> tuple[int, int, float, int]:
    """Moves a clip's ends until its words fit the target: ``start, end`` (ms), the likeness, the rounds taken.

    An end's difference is that of its own likeness and the best one anywhere. Too short a clip grows at the end
    of the smaller difference, too long a one shrinks at that of the larger, the start going first of equals; one of
    fitting length moves both ends as they ask for. Steps shrink from round to round.
    """
    score, known = 0.0, {}
    for n in range(rounds):
        said = " ".join(w for w, s, e in words if s >= start and e <= end)
        if said not in known:  # ends that move to and fro give the same words again
            known[said] = judged(said, target, window, 0.1)
        found = known[said]
        score = found["overall"]
        ratio = len(said) / max(1, len(target))
        move = int(int(max(step, (end - start) * share)) * (1 - n / rounds))
        at_start, at_end = abs(found["start_score"] - found["start_best"]), abs(found["end_score"] - found["end_best"])
        grow_start = grow_end = 0
        if ratio < shortest:
            grow_start, grow_end = (move, 0) if at_start <= at_end else (0, move)
        elif ratio > longest:
            grow_start, grow_end = (-move, 0) if at_start >= at_end else (0, -move)
        elif found["start_action"] == found["end_action"] == "ok":
            return start, end, score, n + 1
        else:
            signs = {"extend": move, "contract": -move, "ok": 0}
            grow_start, grow_end = signs[found["start_action"]], signs[found["end_action"]]
        start = max(0, start - grow_start) if grow_start > 0 else start - grow_start
        end += grow_end
    return start, end, score, rounds


def align_clips(words: DataFrame, clips: DataFrame) -> DataFrame:
    """:func:`aligned` for each clip: ``rec_id, clip_id, start_ms, end_ms, score, rounds``.

    ``words`` has ``rec_id, idx, text, start_ms, end_ms``, ``clips`` has ``rec_id, clip_id, target, start_ms, end_ms``.
    """

    def answers(said: list[tuple], wanted: list[tuple]) -> Iterator[tuple]:
        rows = [(t or "", start, end) for t, start, end in said]
        for number, target, start, end in wanted:
            yield (number, *aligned(rows, target or "", int(start), int(end)))

    schema = f"clip_id {clips.schema['clip_id'].dataType.simpleString()}, start_ms long, end_ms long, score double, rounds int"
    return _by_recording(words, ["text", "start_ms", "end_ms"], clips, ["clip_id", "target", "start_ms", "end_ms"], schema, answers)


@lru_cache(1 << 12)
def _long_words(text: str) -> int:
    return sum(len(w) > 5 for w in text.split())


@lru_cache(1 << 12)
def cleaned(text: str) -> str:
    """As :func:`inkweave.functions.text.clean_phrases`."""
    return " ".join(re.sub(r"[^A-Za-z0-9\s-]", " ", text).split())


@lru_cache(4)
def _word_counts(texts: tuple[str, ...]) -> Counter[str]:
    return Counter(w for t in texts for w in t.split())


def guess_time(rows: list[tuple[str, float, float]], context: str) -> tuple[float | None, float | None, str]:
    """The time a context is about, by the first of four tiers that finds one, with the tier's name.

    1: the first run of rows that are like the context or in it, asking for fewer long words in turn;
    2: the row with a rare token of the context and another telling one that fits best; 3: the likest
    row; 4: the same row, however unlike. An empty transcript has none.
    """
    if not rows:
        return None, None, "none"
    wanted, said = cleaned(context), [cleaned(t) for t, _, _ in rows]
    matcher = SequenceMatcher(None, "", wanted)

    @cache
    def likeness(i: int) -> float:
        matcher.set_seq1(said[i])
        return matcher.ratio()

    masks: dict[str, int] = {}
    for i, c in enumerate(wanted):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(wanted)) - 1

    @cache
    def bound(i: int) -> float:
        """The likeness can't be more: matching blocks are a common subsequence, and the longest one is far quicker found."""
        row = full
        for c in said[i]:
            hit = row & masks.get(c, 0)
            row = (row + hit | row - hit) & full
        return 2.0 * (len(wanted) - row.bit_count()) / ((len(wanted) + len(said[i])) or 1)

    for least in STARTS:
        hits = [i for i, t in enumerate(said) if _long_words(t) >= least and len(t) >= LEAST_CHARS and (t in wanted or bound(i) >= STRONG and likeness(i) >= STRONG)]
        if hits:
            run = [hits[0]]
            for i in hits[1:]:
                if i - run[-1] > 1:
                    break
                run.append(i)
            return min(rows[i][1] for i in run), max(rows[i][2] for i in run), "strong"
    counts = _word_counts(tuple(said))
    words = set(wanted.split())
    rare = {w for w in words if len(w) >= 4 and counts[w] <= 2}
    scored = []
    for i, t in enumerate(said):
        hit = rare & set(t.split())
        if hit and any(len(w) > 5 and w in words and w != w.upper() for w in t.split()):
            bonus = len(hit) + 2 * sum(w.isupper() for w in hit) + 2 * sum("-" in w for w in hit)
            scored.append((0.7 * likeness(i) + 0.3 * bonus, -i))
    if scored:
        i = -max(scored)[1]
        return rows[i][1], rows[i][2], "rare-anchor"
    best = (-1.0, 0, 0)
    for i in sorted(range(len(rows)), key=lambda i: said[i] != wanted):
        matcher.set_seq1(said[i])
        if matcher.real_quick_ratio() >= best[0] and matcher.quick_ratio() >= best[0]:  # both are bounds of the likeness
            best = max(best, (likeness(i), _long_words(said[i]), -i))
    i = -best[2]
    good = likeness(i) >= WEAK and _long_words(said[i]) >= WEAK_WORDS
    return rows[i][1], rows[i][2], "weak" if good else "very weak"


def locate_contexts(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """:func:`guess_time` for each context: ``rec_id, context_id, start, end, tier``; rare tokens are rare in their recording.

    ``rows`` has ``rec_id, idx, text, start, end``, ``contexts`` has ``rec_id, context_id, context``.
    """

    def answers(said: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
        lines = [(t or "", start, end) for t, start, end in said]
        for number, context in asked:
            yield (number, *guess_time(lines, context or ""))

    schema = f"context_id {contexts.schema['context_id'].dataType.simpleString()}, start double, end double, tier string"
    return _by_recording(rows, ["text", "start", "end"], contexts, ["context_id", "context"], schema, answers)


def likest_row(texts: pd.Series, target: str) -> int:
    """The place of the text most like a target, the first of equals; -1 of none."""
    scores = [sequence_ratio(t, target) for t in texts]
    return max(range(len(scores)), key=lambda i: (scores[i], -i)) if scores else -1


#: White space as Python knows it.
_GAP = r"(?U)[\s\x1c-\x1f]+"


def words_of(segments: DataFrame) -> DataFrame:
    """Segments of recordings (``rec_id, idx, text, start, end``) as words with times in equal parts of their segment; words without an ASCII letter or digit are left out."""
    said = F.array_remove(F.split("text", _GAP), "")
    part = (F.col("end") - F.col("start")) / F.greatest(F.size(said), F.lit(1))
    words = segments.where("text is not null").select("rec_id", "idx", "start", part.alias("part"), F.posexplode(said).alias("i", "word"))
    words = words.where(F.lower("word").rlike("[a-z0-9]"))
    return words.select("rec_id", (F.shiftleft(F.col("idx").cast("long"), 32) + F.col("i")).alias("idx"), F.col("word").alias("text"), (F.col("start") + F.col("i") * F.col("part")).alias("start"), (F.col("start") + (F.col("i") + 1) * F.col("part")).alias("end"))
