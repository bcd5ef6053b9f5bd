"""Broken prompt and response pairs: empty, copied, refused, in another language, cut off."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.lexicon import COMMANDS, DECLINING, FUNCTION_WORDS, SCRIPTS, STAND_INS
from inkweave.session import cut

WORD = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")
#: A lead-in before a copy has at most so many words.
LEAD_WORDS = 6
#: What copies are compressed after, so that even a copy of one short word is worth a match.
FRAME = "\x00" + "".join(map(chr, range(33, 97))) + "\x00"
#: Beginnings of up to so many words are counted.
OPENING = 4
#: A context that fewer texts have tells nothing; one with at most one end in so many goes on.
LEAST, BEGINS, LASTS = 3, 10, 50

_WORDS = {k: frozenset(words) for k, words in FUNCTION_WORDS.items()}
_SHARED: Counter[str] = Counter(w for words in _WORDS.values() for w in words)
_LANGUAGES: dict[str, list[tuple[str, float]]] = {w: [(k, 1 / n) for k in _WORDS if w in _WORDS[k]] for w, n in _SHARED.items()}
#: Words that one language alone has.
_OWN = {k: frozenset(w for w in words if _SHARED[w] == 1) for k, words in _WORDS.items()}
_COMMANDS = set(COMMANDS)
_QUOTED = re.compile(r"„[^“”„]*[“”]|“[^“”]*”|«[^«»]*»|‘[^‘’]*’|\"[^\"]*\"")
_QUOTES = re.compile("[„“«‘\"]")
_CLOSERS = {"“": "”", "„": "“”", "«": "»", "‘": "’"}
_BULLET = re.compile(r"\s*(?:[-*•–]|\d+[.)])\s+\S")
_SENTENCE = re.compile(r"[.!?\n]+")
#: A refusal may be wrapped over lines.
_STOPS = re.compile(r"[.!?]+")
_FENCE = re.compile(r"^\s*```\w*\s*|\s*```\s*$")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_LASTS = re.compile(r"(?<![^\W\d_])([^\W\d_]++)[\"'”’»)]*+[.!?…]")
_LINE = re.compile(r"([^\W\d_]+)\W*$")
_JOINED = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)+")
_MARKS = re.compile(r"[“”„«»‘’)]|\((?=\S)")


def said(text: str) -> bool:
    """Whether a text says anything: a letter, digit or picture, and no stand-in for no value."""
    if not any(c.isalnum() or unicodedata.category(c) == "So" for c in text):
        return False
    return " ".join(WORD.findall(text.lower())) not in STAND_INS if len(text) < 80 else True


def spent(asked: str, text: str) -> int:
    """The bytes that a text takes when it is compressed with the prompt as a zstandard dictionary."""
    words, data = (FRAME + asked).encode(), (FRAME + text).encode()
    window = min(max(10, (len(words) + len(data)).bit_length()), 27)
    settings = zstandard.ZstdCompressionParameters.from_level(3, window_log=window, write_content_size=False, write_checksum=False)
    dictionary = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress(data))


@lru_cache(4096)
def _floor(asked: str) -> int:
    return spent(asked, asked)


def copied(prompt: str, response: str) -> bool:
    """Whether a response is nothing but its prompt, once or several times, perhaps after a short lead-in.

    The words of the response are compressed with those of the prompt as a dictionary. A text of a copy's
    length is one if it takes no more bytes than the prompt itself: anything else needs further
    literals or matches. A lead-in is set off by a colon, a dash, a quotation mark.
    """
    asked = _asked(prompt)
    lower = response.lower()
    if not asked or asked.rpartition(" ")[2] not in lower:
        return False
    found = list(WORD.finditer(lower))
    length = sum(m.end() - m.start() for m in found) + len(found) - 1
    for lead in range(min(LEAD_WORDS + 1, len(found))):
        times, rest = divmod(length + 1, len(asked) + 1)
        if not times:
            return False
        if not rest and (not lead or lower[found[lead - 1].end() : found[lead].start()].strip()):
            text = " ".join(m.group() for m in found[lead:])
            size = len(asked)
            if text[size :: size + 1].strip():
                continue
            if all(spent(asked, piece) <= _floor(asked) for piece in {text[i : i + size] for i in range(0, len(text), size + 1)}):
                return True
        length -= found[lead].end() - found[lead].start() + 1
    return False


@lru_cache(4096)
def _asked(prompt: str) -> str:
    return " ".join(WORD.findall(prompt.lower()))


def unquoted(text: str) -> str:
    """A text without its quotations, unless nothing is left of it."""
    if not _QUOTES.search(text):
        return text
    rest = _QUOTED.sub(" ", text)
    return rest if WORD.search(rest) else text


def spoken(words: list[str]) -> dict[str, float]:
    """The frequent words of each language among some words; one of several languages counts in parts."""
    out: dict[str, float] = {}
    for w in words:
        for name, part in _LANGUAGES.get(w, ()):
            out[name] = out.get(name, 0.0) + part
    return out


def language(text: str, least: float = 1.0, hits: int = 2) -> str | None:
    """The language whose frequent words prevail in a text, or None; other scripts count as languages."""
    return _language(LETTERS.findall(text.lower()), least, hits)


def _language(words: list[str], least: float = 1.0, hits: int = 2) -> str | None:
    scores = spoken(words)
    if len({w for w in words if w in _LANGUAGES}) >= hits:
        best = max(scores, key=lambda k: (scores[k], k))
        if scores[best] >= least and scores[best] > 1.25 * max((v for k, v in scores.items() if k != best), default=0):
            return best
    letters = "".join(words)
    for name, first, last in SCRIPTS:
        if len(letters) >= 4 and sum(first <= c <= last for c in letters) * 2 > len(letters):
            return name
    return None


@lru_cache(4096)
def prompt_language(prompt: str) -> str | None:
    """A prompt's language; short commands are English."""
    words = LETTERS.findall(prompt.lower())
    if _COMMANDS.intersection(words) and len(words) < 6:
        return "en"
    return language(prompt, 0.5, 1) or ("en" if _COMMANDS.intersection(words) else None)


def other_language(asked: str | None, text: str, words: list[str]) -> bool:
    """Whether a text without its quotations is wholly in another language: clearly so, and no sentence is in the one asked in."""
    scores = spoken(words)
    found = max(scores, key=lambda k: (scores[k], k), default=None)
    # Languages that are much alike, such as Danish and Norwegian, needn't be told apart from each other, but from the one asked in.
    if found is None or scores[found] < 1 or scores[found] <= 1.25 * scores.get(asked or "", 0.0) or len({w for w in words if w in _LANGUAGES}) < 2:
        found = _language(words)
    if asked is None or found is None or found == asked:
        return False
    known = _WORDS.get(asked)
    if known is None:
        return True
    own = _WORDS.get(found, frozenset())
    for sentence in _SENTENCE.split(text):
        words = LETTERS.findall(sentence.lower())
        if sum(w in known for w in words) > max(1, sum(w in own for w in words)):
            return False
    return True


class _Dictionary:
    """One language's ways to decline, as patterns over a sentence's words."""

    def __init__(self, name: str) -> None:
        self.apostrophes = name == "en"
        #: Where a verb may stand before what denies it.
        self.free = name in ("de", "nl", "sv")
        entries = {k: v.split("|") for k, v in DECLINING[name].items()}
        self.whole = frozenset(entries.pop("whole"))
        self.classes = {k: re.compile("(?<= )(?:" + "|".join(re.escape(w).replace(r"\*", r"[^ ]*") for w in sorted(v, key=len, reverse=True)) + ")(?= )") for k, v in entries.items()}
        starts = [max(w.split(" "), key=len) for k in ("deny", "decline", "rule", "phrase") for w in entries[k]] + [max(w.split(" "), key=len) for w in self.whole]
        self.starts, self.stems = frozenset(w for w in starts if "*" not in w), tuple(w[:-1] for w in starts if "*" in w)

    def concerns(self, words: list[str]) -> bool:
        """Whether a text has any word that each refusal has one of."""
        return not self.starts.isdisjoint(words) or bool(self.stems) and any(w.startswith(self.stems) for w in words)

    def places(self, kind: str, sentence: str) -> list[tuple[int, int]]:
        """The first and last words of each entry of a class."""
        return [(sentence.count(" ", 0, m.start()), sentence.count(" ", 0, m.end())) for m in self.classes[kind].finditer(sentence)]

    def score(self, words: list[str]) -> int:
        """How clearly a sentence declines: each way it does so counts two, hints one, a report of what went wrong takes two off."""
        if not self.apostrophes:
            words = [p for w in words for p in w.split("'")]
        sentence = f" {' '.join(words)} "
        points = 2 * (sentence.strip() in self.whole or bool(self.classes["phrase"].search(sentence)))
        selves = self.places("self", sentence)
        denials = self.places("deny", sentence)
        if selves:
            if denials:
                acts, asks = self.places("act", sentence), self.places("ask", sentence)
                near = lambda d, a: (0 <= a[0] - d[1] + 1 <= 9 or self.free and 0 <= d[0] - a[0] <= 9) and any(d[0] - 6 <= s[0] <= max(a[0], d[1]) for s in selves)
                points += 2 * any(near(d, a) for d in denials for a in acts)
                points += any(near(d, a) for d in denials for a in asks)
            declines = self.places("decline", sentence)
            points += 2 * any(not any(0 <= c[0] - d[1] <= 1 for d in denials) for c in declines)
            if self.classes["rule"].search(sentence):
                points += 2 * bool(self.classes["against"].search(sentence))
        return points - 2 * len({m.group() for m in self.classes["report"].finditer(sentence)}) if points else 0


_DECLINING = {name: _Dictionary(name) for name in DECLINING}


def refused(text: str, words: list[str], languages: Iterable[str] = tuple(DECLINING)) -> bool:
    """Whether a text without its quotations declines in some sentence, by the dictionaries of the languages that it may be in."""
    if "’" in text or "'" in text:
        text = text.replace("’", "'")
        words = words + _JOINED.findall(text.lower())
    for name in languages:
        one = _DECLINING.get(name)
        if one is not None and one.concerns(words):
            for sentence in _STOPS.split(text.lower()):
                tokens = _TOKEN.findall(sentence)
                if one.concerns(tokens) and one.score(tokens) >= 2:
                    return True
    return False


def open_quotation(text: str) -> bool:
    """Whether a quotation, bracket or code block that a text opens isn't closed."""
    waiting: list[str] = []
    for c in _MARKS.findall(text):
        if waiting and c in waiting[-1]:
            waiting.pop()
        elif c == "(":
            waiting.append(")")
        elif c in _CLOSERS:
            waiting.append(_CLOSERS[c])
    return bool(waiting) or text.count("```") % 2 == 1 or text.count('"') % 2 == 1


def begun(words: list[str]) -> int:
    """The key of a context: a text's first words."""
    return xxhash.xxh3_64_intdigest("^" + " ".join(words)) - (1 << 63)


def ending(word: str) -> int:
    """The key of a context: the last word before an end."""
    return xxhash.xxh3_64_intdigest("$" + word) - (1 << 63)


class Contexts:
    """Terminal contexts of texts: how often their first words, and each of their words, stand before an end.

    A sentence ends at its mark and a line of a list at the line's end; where a text just stops, nothing is told.
    """

    def __init__(self) -> None:
        self.words: Counter[str] = Counter()
        self.last: Counter[str] = Counter()
        self.first: Counter[str] = Counter()
        self.whole: Counter[str] = Counter()

    def add(self, lower: str, words: list[str]) -> None:
        """Adds a text in lower case, with its words."""
        self.words.update(words)
        self.first.update([" ".join(words[:n]) for n in range(1, min(OPENING, len(words)) + 1)])
        if len(words) <= OPENING:
            self.whole[" ".join(words)] += 1
        self.last.update(_LASTS.findall(lower))
        if "\n" in lower:
            for line in lower.split("\n"):
                if _BULLET.match(line) and (found := _LINE.search(line)):
                    self.last[found.group(1)] += 1

    def counts(self) -> Iterator[tuple[int, int, int]]:
        """The key of each context, its number and that of its ends."""
        for word, n in self.words.items():
            yield ending(word), n, min(self.last[word], n)
        for words, n in self.first.items():
            yield begun([words]), n, self.whole[words]


#: An answer that only its contexts can decide: their keys, and what the last word tells where both are too rare.
Open = tuple[int, int, bool]


def truncated(response: str) -> bool | Open:
    """Whether a text stops before its sentence, quotation, code block or object is finished, or the contexts that tell.

    The terminal contexts of short texts and of lists, which need no full stop, decide by how often texts go on there.
    """
    text = response.strip().strip("​﻿")
    body = _FENCE.sub("", text) if text.startswith("```") else text
    if body[:1] in "{[" and body[:2] != "[[" or text.startswith("```"):
        try:
            json.loads(body)
            return text.count("```") % 2 == 1
        except (ValueError, RecursionError):
            if body[:1] in "{[" and (body.count("{") > body.count("}") or body.count("[") > body.count("]")):
                return True
    if open_quotation(text):
        return True
    end = text.rstrip("\"'”“’»)]*_` ")
    if end.endswith(("…", "...")):
        return bool(WORD.search(text))
    if end.endswith((".", "!", "?", "。", "！", "？", "؟", "।")):
        return False
    if text[-1:] in ")`”»" or not (end[-1:].isalnum() or end[-1:] in ",;:-–—&/"):
        return False
    if end[-1:] in ",;:-–—&/":
        return True
    last = text.splitlines()[-1]
    words = LETTERS.findall(last.lower())
    rare = len(words) > 1 and words[-1] in _LANGUAGES
    if _BULLET.match(last):
        return (0, ending(words[-1]), rare) if words else False
    if re.search(r"[.!?…]\s+\S", text) or len(last.split()) > OPENING:  # sentences, of which the last isn't finished
        return True
    whole = LETTERS.findall(text.lower())
    return (begun(whole), ending(whole[-1]), rare) if len(whole) > 1 else False


def goes_on(first: tuple[int, int] | None, last: tuple[int, int] | None, rare: bool, listed: bool = False) -> bool:
    """Whether texts go on after these contexts, each given as its number and that of its ends.

    The first words tell before the last word; contexts that hardly any text has leave it to the last word's
    kind. A text's own end, which is counted for its first words and in lists, tells nothing about itself.
    """
    if first is not None and first[0] >= LEAST:
        return (first[1] - 1) * BEGINS <= first[0] - 1
    if last is not None and last[0] >= LEAST:
        return (last[1] - listed) * LASTS <= last[0] - listed
    return rare


def defect(prompt: str | None, response: str | None, words: list[str]) -> str | None | Open:
    """The first defect of a pair that applies, None, or the contexts that tell whether it is truncated; ``words`` are the response's."""
    if response is None or not said(response):
        return "empty"
    prompt = prompt or ""
    if copied(prompt, response):
        return "copied"
    asked, text = prompt_language(prompt), unquoted(response)
    if text is not response:
        words = LETTERS.findall(text.lower())
    # Where one word in eight is one that the prompt's language alone has, the text isn't in another.
    if asked in _OWN and 8 * sum(map(_OWN[asked].__contains__, words)) >= len(words) >= 4:
        languages, other = [asked], False
    else:
        scores = spoken(words)
        most = max(scores.values(), default=0)
        languages = [k for k, v in scores.items() if 2 * v >= most]
        other = most > scores.get(asked or "", 0.0) and response.lstrip()[:1] not in "{[`" and other_language(asked, text, words)
    if refused(text, words, languages):
        return "refusal"
    if other:
        return "other_language"
    found = truncated(response)
    return ("truncated" if found else None) if isinstance(found, bool) else found


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """``id, field_name, defect`` of the defective pairs among ``id, field_name, prompt, response``.

    Method: copies are found by compressing the response with the prompt as a zstandard dictionary;
    refusals and languages by dictionaries that are scored for each language; cut-off texts by their
    terminal contexts (open quotations, brackets, code and objects; and for short texts and lists how
    often texts of the table go on after the first words and after the last one). The contexts of all
    rows are counted, whatever their number, and joined with the answers that they must decide: a
    context tells from :data:`LEAST` texts on, in a table of any size.
    Null responses: empty. Null prompts: nothing can be a copy or in another language. Repeated rows
    give one result. An empty table: no rows. Pairs are read once; only contexts' counts and defects are shuffled.
    """
    pairs = pairs.select("id", "field_name", F.col("prompt").cast("string"), F.col("response").cast("string"))
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Contexts()
        arrow = (pa.string(), pa.string())
        for batch in batches:
            arrow = (batch.column(0).type, batch.column(1).type)
            rows, found = [], []
            for i, (prompt, response) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                words: list[str] = []
                if response is not None:
                    lower = response.lower()
                    words = LETTERS.findall(lower)
                    seen.add(lower, words)
                label = defect(prompt, response, words)
                if label is not None:
                    rows.append(i)
                    found.append((label, None, None, None) if isinstance(label, str) else (None, *label))
            if rows:
                at = pa.array(rows, pa.int64())
                yield result(batch.column(0).take(at), batch.column(1).take(at), found)
            if len(seen.words) + len(seen.first) > 200_000:
                yield counted(seen, arrow)
                seen = Contexts()
        if seen.first:
            yield counted(seen, arrow)

    names = ["id", "field_name", "defect", "begun", "ending", "rare", "context", "n", "ended"]

    def result(ids: pa.Array, fields: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        none = pa.nulls(len(found), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([ids, fields, *columns, none, none, none], names)

    def counted(seen: Contexts, arrow: tuple) -> pa.RecordBatch:
        counts = [pa.array(c, pa.int64()) for c in zip(*seen.counts())]
        none = [pa.nulls(len(counts[0]), t) for t in (*arrow, pa.string(), pa.int64(), pa.int64(), pa.bool_())]
        return pa.RecordBatch.from_arrays([*none, *counts], names)

    told = cut(pairs.mapInArrow(run, f"id {kind}, field_name string, defect string, begun long, ending long, rare boolean, context long, n long, ended long"))
    counts = told.where("context is not null").groupBy("context").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended")).where(F.col("n") >= LEAST)
    of = lambda key, p: counts.select(F.col("context").alias(key), F.col("n").alias(f"{p}_n"), F.col("ended").alias(f"{p}_ended"))
    waiting = told.where("ending is not null").join(of("begun", "b"), "begun", "left").join(of("ending", "e"), "ending", "left")
    own = (F.col("begun") == 0).cast("long")
    goes = F.coalesce((F.col("b_ended") - 1) * BEGINS <= F.col("b_n") - 1, (F.col("e_ended") - own) * LASTS <= F.col("e_n") - own, "rare")
    cut_off = waiting.where(goes).select("id", "field_name", F.lit("truncated").alias("defect"))
    return told.where("defect is not null").select("id", "field_name", "defect").unionByName(cut_off).distinct()


def trace_pairs(traces: DataFrame) -> DataFrame:
    """The pairs of evaluation traces: each response, and the reasoning of each valid ``intent_llm`` that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                start, end = text.find("{"), text.rfind("}")
                try:
                    value = json.loads(text[start : end + 1]) if 0 <= start < end else None
                except (ValueError, RecursionError):
                    continue
                if isinstance(value, dict) and "reasoning" in value:
                    said_ = value["reasoning"]
                    keep.append(i)
                    found.append(said_ if said_ is None or isinstance(said_, str) else json.dumps(said_))
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(["reasoning"] * len(keep), pa.string()), batch.column(1).take(rows), pa.array(found, pa.string())], ["id", "field_name", "prompt", "response"])

    traces = traces.where("trace_id is not null")
    answers = traces.select(F.col("trace_id").alias("id"), F.lit("agent_response").alias("field_name"), "prompt", F.col("agent_response").alias("response"))
    reasons = traces.where("intent_llm is not null").select("trace_id", "prompt", "intent_llm").mapInArrow(run, "id long, field_name string, prompt string, response string")
    return answers.unionByName(reasons)
