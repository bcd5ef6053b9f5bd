"""Similarity flooding between two small schema graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np

#: A field of a schema: its parent ('' at the top), its name and a bit set of its JSON types.
Field = tuple[str, str, int]


def plain(name: str) -> str:
    """A name without case and separators."""
    return "".join(c for c in name.lower() if c.isalnum())


@lru_cache(1 << 16)
def likeness(a: str, b: str) -> float:
    """How like two names are."""
    return SequenceMatcher(None, plain(a), plain(b), False).ratio()


def _edges(nodes: dict[tuple, int], fields: list[Field]) -> list[tuple[int, str, int]]:
    """A parent's edges to its fields (the schema's to its top-level ones), and a field's to its types."""
    tops = {name: nodes["field", ("", name)] for parent, name, _ in fields if not parent}
    out = []
    for parent, name, types in fields:
        at = nodes["field", (parent, name)]
        out.append((tops.get(parent, 0) if parent else 0, "has", at))
        out += [(at, "type", nodes["type", b]) for b in range(8) if types >> b & 1]
    return out


def flood(old: Iterable[Field], new: Iterable[Field], agreeing: Mapping[tuple[Field, Field], float] | None = None, rounds: int = 100, close: float = 1e-4) -> dict[tuple[Field, Field], float]:
    """The similarity of every field of one schema to every field of the other under the same parent.

    Nodes are the schema, its parents, its fields and the JSON types. A pair of nodes passes its score
    on, in equal shares, to the pairs that are next to it by an equal edge, and begins with the
    likeness of their names and, for fields of ``agreeing``, the share of values that agree. Scores are added, scaled to 1 and passed on again until they hardly change.
    """
    old, new = list(old), list(new)
    sides = []
    for fields in (old, new):
        nodes: dict[tuple, int] = {("root", ""): 0}
        for parent, name, _ in fields:
            nodes.setdefault(("field", (parent, name)), len(nodes))
        for bit in range(8):
            nodes["type", bit] = len(nodes)
        sides.append((list(nodes), _edges(nodes, fields)))
    (left, left_edges), (right, right_edges) = sides
    by_label: dict[str, list[tuple[int, int]]] = {}
    for a, label, b in right_edges:
        by_label.setdefault(label, []).append((a, b))
    agree = {(a[:2], b[:2]): share for (a, b), share in (agreeing or {}).items()}
    pairs: dict[tuple[int, int], int] = {}
    start: list[float] = []

    def pair(i: int, j: int) -> int:
        if (i, j) not in pairs:
            pairs[i, j] = len(start)
            a, b = left[i][1], right[j][1]
            start.append(likeness(a[1], b[1]) + agree.get((a, b), 0.0) if left[i][0] == "field" else float(a == b))
        return pairs[i, j]

    links: dict[str, list[tuple[int, int]]] = {"has": [], "type": []}
    for a, label, b in left_edges:
        for c, d in by_label.get(label, ()):
            if left[a][0] == right[c][0] and (left[b][0] != "field" or left[b][1][0] == right[d][1][0]):
                links[label].append((pair(a, c), pair(b, d)))
    if not start:
        return {}
    size, flows = len(start), []
    for ends in links.values():
        for here, there in ((0, 1), (1, 0)):  # along and against the edges
            if ends:
                source, target = np.array([e[here] for e in ends]), np.array([e[there] for e in ends])
                flows.append((source, target, 1.0 / np.bincount(source, minlength=size)[source]))
    source, target, weight = (np.concatenate(x) for x in zip(*flows)) if flows else (np.empty(0, int), np.empty(0, int), np.empty(0))
    first = np.array(start)
    score = first.copy()
    for _ in range(rounds):
        sent = first + score
        grown = sent + np.bincount(target, weight * sent[source], size)
        grown /= grown.max() or 1.0
        if np.abs(grown - score).max() < close:
            break
        score = grown
    kind_old, kind_new = {(f[0], f[1]): f for f in old}, {(f[0], f[1]): f for f in new}
    return {(kind_old[left[i][1]], kind_new[right[j][1]]): float(score[k]) for (i, j), k in pairs.items() if left[i][0] == "field"}


def selected(scores: Mapping[tuple[Field, Field], float], borne: Callable[[tuple[Field, Field]], bool]) -> list[tuple[Field, Field]]:
    """Consistent correspondences: by falling score, each field at most once.

    A correspondence that isn't ``borne`` out by the records is withdrawn, and leaves its fields to the next best.
    """
    done_old, done_new, out = set(), set(), []
    for old, new in sorted(scores, key=lambda p: (-scores[p], p)):
        if old not in done_old and new not in done_new and borne((old, new)):
            done_old.add(old)
            done_new.add(new)
            out.append((old, new))
    return out
