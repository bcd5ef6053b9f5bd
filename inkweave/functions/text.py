"""String, similarity and JSON column functions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space at both ends, by Unicode, as Python's strip has it.
_ENDS = r"(?U)^\s+|\s+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(text: Column | str) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(_col(text), _ENDS, "")


def clean_phrases(text: Column | str) -> Column:
    """Everything but ASCII letters, digits, white space and hyphens becomes one space; spaces are collapsed."""
    kept = F.regexp_replace(_col(text), r"(?U)[^A-Za-z0-9\s\-]", " ")
    return stripped(F.regexp_replace(kept, r"(?U)\s+", " "))


def tokens(text: Column | str) -> Column:
    """The words of a cleaned text; an empty one has none."""
    return F.filter(F.split(clean_phrases(text), " "), lambda w: w != "")


def non_filler_words(text: Column | str, longer_than: int = 5) -> Column:
    """How many words between white space are longer than that."""
    return F.size(F.filter(F.split(stripped(text), r"(?U)\s+"), lambda w: F.char_length(w) > longer_than))


def spoken(text: Column | str) -> Column:
    """A transcript's text in lower case without anything but word characters and white space."""
    return stripped(F.regexp_replace(F.lower(_col(text)), r"(?U)[^\w\s]", ""))


def without_thinking(text: Column | str) -> Column:
    """A model's answer without its ``<think>`` blocks."""
    return stripped(F.regexp_replace(_col(text), r"(?s)<think>.*?</think>", ""))


def braced(text: Column | str, fallback: bool = False) -> Column:
    """From the first brace to the last; without one null, or with ``fallback`` the text itself."""
    found = F.regexp_extract(_col(text), r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(_col(text) if fallback else F.lit(None).cast("string"))


def parsed_answer(raw: Column | str) -> Column:
    """A model's answer as a variant: its JSON object, or ``{"error": "invalid_json", "raw": ...}``."""
    cleaned = without_thinking(_col(raw).cast("string"))
    failed = F.parse_json(F.to_json(F.struct(F.lit("invalid_json").alias("error"), F.coalesce(cleaned, F.lit("")).alias("raw"))))
    return F.coalesce(F.try_parse_json(braced(cleaned)), failed)


def answer_key(answer: Column, key: str, kind: str = "string", exact: bool = True) -> Column:
    """One key of a parsed answer if it has exactly that type, else null (a boolean is no number).

    Unless ``exact`` it may be a value of a kind below: a boolean counts as the whole number 0 or 1.
    """
    path, expected = f"$.{key}", {"string": "STRING", "bigint": "BIGINT", "double": "DOUBLE|DECIMAL.*|FLOAT", "boolean": "BOOLEAN"}[kind]
    value = F.try_variant_get(answer, path, "variant")
    found = F.when(F.schema_of_variant(value).rlike(f"^({expected})"), F.try_variant_get(answer, path, kind))
    if exact or kind != "bigint":
        return found
    return F.coalesce(found, F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(answer, path, "boolean").cast("bigint")))


def title(text: Column | str) -> Column:
    """The first non-empty quoted part of a text that begins with a quote, or its first non-empty line, without one full stop at the end."""
    t = _col(text)
    first = lambda parts: F.element_at(F.filter(parts, lambda p: p != ""), 1)
    picked = F.when(t.startswith('"'), F.try_element_at(F.filter(F.split(t, '"'), lambda p: p != ""), F.lit(1))).when(t.contains("\n"), first(F.split(t, "\n"))).otherwise(t)
    return F.regexp_replace(picked, r"\.$", "")


def last_word(text: Column | str, least: int = 3) -> Column:
    """The last word of a text of at least three."""
    parts = F.split(stripped(text), r"(?U)\s+")
    return F.when(F.size(parts) >= least, F.element_at(parts, -1))


def after_colon(text: Column | str) -> Column:
    """What follows the first colon."""
    t = _col(text)
    return F.when(t.contains(":"), stripped(F.substring(t, F.instr(t, ":") + 1, F.char_length(t))))


def title_case(name: Column | str) -> Column:
    """A step's name for people."""
    return F.initcap(F.replace(_col(name), F.lit("_"), F.lit(" ")))


def case_aliases(name: Column | str, docket: Column | str) -> Column:
    """Other ways to write a case's name, and its docket number, each once and in order."""
    n = _col(name)
    spelled = F.array(n, F.replace(n, F.lit(","), F.lit("")), F.replace(n, F.lit("v."), F.lit("v")), F.replace(n, F.lit("v"), F.lit("v.")), _col(docket))
    return F.array_distinct(F.filter(spelled, lambda a: a.isNotNull() & (a != "")))


def joined_messages(messages: Column | str) -> Column:
    """An array's messages that say anything, stripped, with a blank line between them."""
    return F.array_join(F.filter(F.transform(_col(messages), lambda m: stripped(m)), lambda m: m.isNotNull() & (m != "")), "\n\n")


def rendered(icon: Column, heading: Column, body: Column, bullets: Column, footer: Column) -> Column:
    """A message in Markdown: icon and heading, body, bullets, footer, each only if there."""
    head = F.concat_ws(" ", icon, F.when(heading.isNotNull(), F.concat(F.lit("**"), heading, F.lit("**"))))
    items = F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n")
    parts = F.array(head, body, items, footer)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n\n")


def run_label(at: Column | str, key: Column | str) -> Column:
    """``Run Mon DD YYYY HH:MM AM (id6)``."""
    return F.concat(F.date_format(_col(at), "'Run' MMM dd yyyy hh:mm a"), F.lit(" ("), F.left(_col(key), F.lit(6)), F.lit(")"))


_NOT_PLAIN = re.compile("[^a-z0-9]+")


def plain_letters(text: str) -> str:
    """A text's ASCII letters and digits in lower case."""
    return _NOT_PLAIN.sub("", text.lower())


def sequence_ratio(a: str, b: str) -> float:
    """difflib's ratio of the plain letters of two texts; the order of the arguments matters."""
    return SequenceMatcher(None, plain_letters(a), plain_letters(b)).ratio()


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, with one bit of an integer for each character of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def edit_ratio(a: str, b: str) -> float:
    """100 times the share of characters in the longest common subsequence; 100 for two empty texts."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_subsequence(a, b) / total


def _pairwise(function, kind: T.DataType):
    @F.pandas_udf(kind)
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)], dtype="object" if kind == T.StringType() else "float64")

    return udf


def fuzzy_ratio(a: Column | str, b: Column | str) -> Column:
    """:func:`sequence_ratio` of two columns (difflib is Python's, so this is an Arrow UDF)."""
    return _pairwise(sequence_ratio, T.DoubleType())(_col(a), _col(b))


def subsequence_ratio(a: Column | str, b: Column | str) -> Column:
    """:func:`edit_ratio` of two columns."""
    return _pairwise(edit_ratio, T.DoubleType())(_col(a), _col(b))


def size_tier(tiers: Iterable[Column], most: Column | int | None) -> Column:
    """The first of several texts that is short enough, else the last; without a limit the first."""
    tiers = list(tiers)
    if most is None:
        return tiers[0]
    limit = most if isinstance(most, Column) else F.lit(most)
    return F.coalesce(*(F.when(F.char_length(t) <= limit, t) for t in tiers), tiers[-1])
