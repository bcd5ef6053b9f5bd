"""Bit-sliced comparison: one bit of 64 records in each word, distances counted by carry-save adders."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bits of a record's sketch, and planes added between two looks at which words are still needed.
BITS, STEP = 256, 64
#: Words that are compared at once.
CHUNK = 2_048


def bits(sketches: np.ndarray) -> np.ndarray:
    """The bits of sketches given as rows of four 64-bit words: ``[bit, record]``, with records up to a multiple of 64."""
    rows = -(-len(sketches) // 64) * 64
    padded = np.zeros((rows, BITS // 64), U)
    padded[: len(sketches)] = sketches
    return np.ascontiguousarray(np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little").T)


def planes(rows: np.ndarray) -> np.ndarray:
    """The bit planes of :func:`bits`: ``[bit, record // 64]``."""
    return np.ascontiguousarray(np.packbits(rows, axis=1, bitorder="little")).view(U)


def add(counters: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    """Adds bit planes to counters (least plane first) by carry-save adders: three planes of one
    weight become one of that weight and one of twice the weight, until each weight has one."""
    level, pending, out = 0, rows, []
    while len(pending) or level < len(counters):
        if level < len(counters):
            pending = np.concatenate([pending, counters[level][None]])
        carries = []
        while len(pending) > 1:
            third = len(pending) // 3
            if not third:
                a, b = pending
                carries.append((a & b)[None])
                pending = (a ^ b)[None]
                break
            a, b, c = pending[:third], pending[third : 2 * third], pending[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (c & half))
            pending = np.concatenate([half ^ c, pending[3 * third :]])
        out.append(pending[0])
        pending = np.concatenate(carries) if carries else pending[:0]
        level += 1
    return out


def unpacked(words: np.ndarray) -> np.ndarray:
    """The bits of words, least first."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little")


def beyond(counters: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """The records, as bits, whose counter is greater than the limit of their word: compared plane by plane, the greatest first."""
    more, same = np.zeros(len(limit), U), np.full(len(limit), ~U(0))
    for k in range(max(len(counters), int(limit.max()).bit_length()) - 1, -1, -1):
        bit = (U(0) - ((limit >> k) & 1).astype(U)) if len(limit) else np.empty(0, U)
        if k < len(counters):
            more |= same & counters[k] & ~bit
            same &= ~(counters[k] ^ bit)
        else:
            same &= ~bit
    return more


def close_pairs(group: np.ndarray, size: np.ndarray, lead: np.ndarray, sketch: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within groups that may have a Jaccard similarity of ``num / den``.

    ``group`` is sorted; in each group the records that ``lead`` come first, and those that do and those
    that don't are sorted by ``size``, the sizes of the sets. A pair has a leading record and one of
    its size or larger. ``sketch`` has a bit set for each element's hash. Sets differ in at least as many elements as their sketches in bits, and similar
    sets in at most ``(den - num) / (den + num)`` of their sizes' sum, so no similar pair is lost.
    A leading record is held against whole words of 64 others at once; words in which every record is
    beyond the radius are abandoned between steps.
    """
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(group):
        return nothing
    n = size.astype(np.int64)
    # Of each leading record the places of the larger sets that are small enough: first those that lead.
    group_of = np.cumsum(np.append(False, group[1:] != group[:-1])) * 2
    wide = int(n.max()) * den // num + 2
    limit, here = n * den // num, np.flatnonzero(lead)
    places = (group_of + ~lead) * wide + n
    at, most = group_of[here] * wide, limit[here]
    ends = np.searchsorted(places, at + most, "right"), np.searchsorted(places, at + wide + most, "right")
    starts = here + 1, np.searchsorted(places, at + wide + n[here])
    record, low, high = np.tile(here, 2), np.concatenate(starts), np.concatenate(ends)
    some = high > low
    record, low, high = record[some], low[some], high[some]
    # A row for each leading record and word of others.
    words = ((high - 1) >> 6) - (low >> 6) + 1
    which = np.repeat(np.arange(len(record)), words)
    word = (low >> 6)[which] + np.arange(len(which)) - np.repeat(np.cumsum(words) - words, words)
    every = ~U(0)
    alive = every << np.maximum(low[which] - word * 64, 0).astype(U) & every >> np.maximum((word + 1) * 64 - high[which], 0).astype(U)
    record = record[which]
    rows = bits(sketch)
    columns = planes(rows)
    largest = np.pad(n, (0, columns.shape[1] * 64 - len(n))).reshape(-1, 64).max(axis=1)
    radius = (n[record] + np.minimum(limit[record], largest[word])) * (den - num) // (den + num)
    left, right = [], []
    for begin in range(0, len(record), CHUNK):
        part = slice(begin, begin + CHUNK)
        i, j, live, far, counters = record[part], word[part], alive[part], radius[part], []
        for step in range(0, BITS, STEP):
            mine = U(0) - np.take(rows[step : step + STEP], i, axis=1).astype(U)
            counters = add(counters, mine ^ np.take(columns[step : step + STEP], j, axis=1))
            live = live & ~beyond(counters, far)
            keep = live != 0
            if not keep.all():
                i, j, live, far, counters = i[keep], j[keep], live[keep], far[keep], [c[keep] for c in counters]
            if not len(i):
                break
        if len(i):
            row, lane = np.nonzero(unpacked(live).reshape(-1, 64))
            a, b = i[row], j[row] * 64 + lane
            distance = sum((((c[row] >> lane.astype(U)) & U(1)).astype(np.int64) << k for k, c in enumerate(counters)), np.zeros(len(a), np.int64))
            near = distance <= (n[a] + n[b]) * (den - num) // (den + num)
            left.append(a[near])
            right.append(b[near])
    if not left:
        return nothing
    return np.concatenate(left), np.concatenate(right)
