"""Deeply nested records as flat tables that keep parent-child links."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A lone object under one of these names counts as an array of one.
LONE = ("segments", "clips", "marks", "options", "evidence", "spans", "filters", "targets")
#: Bytes that are indexed at once.
CHUNK = 1 << 20

QUOTE, BACKSLASH, COMMA, COLON, OPEN_ARRAY, CLOSE_ARRAY, OPEN_OBJECT, CLOSE_OBJECT = b'"\\,:[]{}'


class Index:
    """The containers of a row of JSON texts, found by bitmaps over their bytes.

    Bitmaps of quotes, brackets and delimiters; a prefix sum of the quotes tells what is inside a
    string, a prefix sum of the brackets how deep each byte is. Bytes of one depth, in order, run
    from each opening bracket to its closing one, so a running maximum gives each its container. The
    texts must be valid JSON objects or arrays. For each container, in the order of their opening:
    ``start`` and ``end`` (bytes), ``is_object``, ``parent`` (its container or -1), ``slot`` (its
    number in a parent array), ``key_start`` and ``key_end`` (its key in a parent object).
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts)
        data = np.frombuffer(self.data, np.uint8)
        place = np.arange(len(data), dtype=np.int64)
        # A quote is escaped if an odd number of backslashes comes just before it.
        quotes = np.flatnonzero(data == QUOTE)
        other = np.maximum.accumulate(np.where(data != BACKSLASH, place, -1))
        before = quotes - 1
        quotes = quotes[(before < 0) | ((before - other[np.maximum(before, 0)]) % 2 == 0)]
        flips = np.zeros(len(data), np.int8)
        flips[quotes] = 1
        outside = (np.cumsum(flips) & 1) == 0
        outside[quotes] = False
        opens = outside & ((data == OPEN_ARRAY) | (data == OPEN_OBJECT))
        closes = outside & ((data == CLOSE_ARRAY) | (data == CLOSE_OBJECT))
        marks = np.flatnonzero(opens | closes | (outside & ((data == COMMA) | (data == COLON))))
        kind, opening, closing = data[marks], opens[marks], closes[marks]
        depth = np.cumsum(opening.astype(np.int64) - closing)
        level = depth + closing  # a closing bracket belongs to what it closes
        order = np.argsort(level, kind="stable")
        slot_of = np.empty(len(marks), np.int64)
        slot_of[order] = np.arange(len(marks))
        number = np.cumsum(opening) - 1  # of each opening bracket among them
        first = np.maximum.accumulate(np.where(opening[order], np.arange(len(marks)), -1)) if len(marks) else np.empty(0, np.int64)
        container = np.empty(len(marks), np.int64)
        container[order] = number[order[first]]
        at = np.flatnonzero(opening)
        self.start, self.is_object = marks[at], kind[at] == OPEN_OBJECT
        self.end = np.empty(len(at), np.int64)
        self.end[container[closing]] = marks[closing] + 1
        # The mark before an opening bracket is its parent's: the parent itself, a comma, a colon or the end of a neighbour.
        previous = at - 1
        inner = (depth[at] > 1) & (previous >= 0)
        previous = np.maximum(previous, 0)
        self.parent = np.where(inner, container[previous], -1) if len(at) else np.empty(0, np.int64)
        commas = np.cumsum((kind == COMMA)[order])
        count = np.empty(len(marks), np.int64)
        count[order] = commas
        self.slot = np.where(inner, count[previous] - count[at[np.maximum(self.parent, 0)]], 0) if len(at) else np.empty(0, np.int64)
        self.key_start, self.key_end = self._keys(quotes, marks[previous] if len(at) else np.empty(0, np.int64))
        colons = np.flatnonzero(kind == COLON)
        self.colon_of, (self.name_start, self.name_end) = container[colons], self._keys(quotes, marks[colons])
        self.text_of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, "right")

    def _keys(self, quotes: np.ndarray, colons: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(quotes, colons)
        if not len(quotes):
            return np.zeros(len(colons), np.int64), np.zeros(len(colons), np.int64)
        return quotes[np.maximum(at - 2, 0)] + 1, quotes[np.maximum(at - 1, 0)]

    def repeated(self) -> set[int]:
        """The texts in which an object may have a key twice; others surely don't."""
        if not len(self.colon_of):
            return set()
        data = np.frombuffer(self.data, np.uint8).astype(np.int64)
        total = np.append(0, np.cumsum(data))
        width = self.name_end - self.name_start
        mark = (total[self.name_end] - total[self.name_start]) * 65_537 + width * 257 + data[np.minimum(self.name_start, len(data) - 1)]
        order = np.lexsort((mark, self.colon_of))
        same = (np.diff(self.colon_of[order]) == 0) & (np.diff(mark[order]) == 0)
        return set(self.text_of[self.colon_of[order[1:][same]]].tolist())

    def key(self, c: int) -> str:
        raw = self.data[self.key_start[c] : self.key_end[c]]
        return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode()


def valid(text: str | None) -> bool:
    """Whether a text is a JSON object or array."""
    try:
        return isinstance(json.loads(text or ""), (dict, list))
    except (ValueError, RecursionError):
        return False


#: A JSON text to look into: the path of its value, the keys that lead to the part wanted (None: any key), the text.
Part = tuple[str, tuple, str]


def nodes(parts: list[Part], lone: tuple[str, ...] = LONE) -> Iterator[tuple[int, str, str, str]]:
    """The objects that are array elements, at any depth, of valid JSON texts.

    Each is the text's number, the object's path, the path of the nearest such object around it or '',
    and the object's JSON.
    """
    encoded = [text.encode("utf-8", "surrogatepass") for _, _, text in parts]
    index = Index(encoded)
    if again := index.repeated():
        for i in again:  # of a repeated key the last value counts
            encoded[i] = json.dumps(json.loads(parts[i][2])).encode()
        index = Index(encoded)
    paths: list[str] = []
    nearest: list[str] = []
    led: list[int] = []  # how many of the leading keys were met, -1 beside them
    parents, slots, objects, text_of = index.parent.tolist(), index.slot.tolist(), index.is_object.tolist(), index.text_of.tolist()
    for c, p in enumerate(parents):
        root, lead, _ = parts[text_of[c]]
        element = single = False
        around = nearest[p] if p >= 0 else ""
        if p < 0:
            path, met = root, 0
        else:
            met = led[p]
            if objects[p]:
                name = index.key(c)
                path, single = f"{paths[p]}.{name}", met == len(lead) and name in lone
                if 0 <= met < len(lead):
                    met = met + 1 if lead[met] in (None, name) else -1
            else:
                path, element = f"{paths[p]}[{slots[c]}]", met == len(lead)
                if met < len(lead):
                    met = -1
        if objects[c] and single:
            path, element = f"{path}[0]", True
        paths.append(path)
        led.append(met)
        if objects[c] and element:
            yield text_of[c], path, around, index.data[index.start[c] : index.end[c]].decode("utf-8", "surrogatepass")
            around = path
        nearest.append(around)


def flattened(
    df: DataFrame, key: str, text: str, parts: Callable[[str], Iterator[Part]], table_name: str, lone: tuple[str, ...] = LONE, content: bool = False
) -> DataFrame:
    """One row for each object that is an array element, at any depth: ``table_name, record_id,
    node_path, parent_path``, and with ``content`` the object's JSON as ``node``.

    ``parts`` gives of a row's text the JSON texts to look into. A node's parent is the row with its
    ``parent_path``; the paths of one record are unique, so a path is its object's key and its
    parent's foreign key. Rows are not shuffled.
    Method: vectorised structural indexing (:class:`Index`) of many texts at once.
    Null keys, null texts and texts that are no valid JSON: no rows. Repeated rows: repeated results.
    """
    names = ["table_name", "record_id", "node_path", "parent_path", *["node"] * content]

    def emitted(keys: list[str], some: list[Part]) -> pa.RecordBatch:
        out = [(table_name, keys[i], path, around, node)[: len(names)] for i, path, around, node in nodes(some, lone)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        some: list[Part] = []
        size = 0
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in parts(value):
                    keys.append(k)
                    some.append(part)
                    size += len(part[2])
                    if size > CHUNK:
                        yield emitted(keys, some)
                        keys, some, size = [], [], 0
        if some:
            yield emitted(keys, some)

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string"), F.col(text).cast("string"))
    return rows.mapInArrow(run, ", ".join(f"{n} string" for n in names))


def whole(root: str) -> Callable[[str], Iterator[Part]]:
    """The whole text, as the value of ``root``."""
    return lambda text: iter([(root, (), text)] if valid(text) else [])


def braced_member(root: str, member: str) -> Callable[[str], Iterator[Part]]:
    """One member of the object from a text's first brace to its last."""

    def parts(text: str) -> Iterator[Part]:
        start, end = text.find("{"), text.rfind("}")
        if 0 <= start < end and valid(text[start : end + 1]):
            yield root, (member,), text[start : end + 1]

    return parts


def step_members(root: str, member: str) -> Callable[[str], Iterator[Part]]:
    """One member of each member of an object; a string that holds JSON counts as that JSON."""

    def parts(text: str) -> Iterator[Part]:
        try:
            steps = json.loads(text)
        except (ValueError, RecursionError):
            return
        if isinstance(steps, dict):
            yield root, (None, member), text
            for name, step in steps.items():
                value = step.get(member) if isinstance(step, dict) else None
                if isinstance(value, str) and valid(value):
                    yield f"{root}.{name}.{member}", (), value

    return parts


def latest(df: DataFrame, keys: list[str], order: str, keep: list[str]) -> DataFrame:
    """Of several rows for one key the one with the greatest ``order``; nulls come first, and the greatest of ``keep`` wins a tie."""
    rest = F.max(F.struct(F.col(order).alias("__order"), *keep)).alias("__last")
    return df.groupBy(*keys).agg(rest).select(*keys, *(F.col(f"__last.{k}").alias(k) for k in keep))
