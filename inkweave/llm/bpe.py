"""Byte-level BPE of a public vocabulary, merged by a hierarchical-bitmap rank queue."""

from __future__ import annotations

import json
from itertools import chain

import regex

#: The pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is
    visible Latin-1, else the next free code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, free = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in names:
            names[b], free = chr(free), free + 1
    return names


class ByteBPE(dict):
    """Text pieces to ids: a dict that merges a piece when it is first asked for.

    The dict is a cache of bounded size (``cached`` pieces of at most 64 characters); it is emptied
    when full, which costs time and changes nothing.
    """

    def __init__(self, vocabulary: str, cached: int = 1 << 18) -> None:
        super().__init__()
        with open(vocabulary, encoding="utf-8") as f:
            found = json.load(f)
        model, before = found["model"], found.get("pre_tokenizer") or {}
        # Another way to split, or to normalise, would give other ids.
        if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or found.get("normalizer"):
            raise ValueError(f"{vocabulary} is no byte-level BPE with the usual pattern")
        vocab, names = model["vocab"], byte_names()
        self.first = [vocab[names[b]] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.pieces = regex.compile(PATTERN).findall
        self.cached = cached

    def __missing__(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        ids = self.merge(data)
        if len(piece) <= 64:
            if len(self) >= self.cached:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece: time in proportion to its length, but for the sorts of the buckets.

        A hierarchical bitmap is the queue: each merge rank has a bucket of positions in the linked list
        of tokens, a word of 64 bits says which of 64 ranks have one, a bitmap over the words which of
        them are not empty. Two find-first-set steps give the lowest rank, however many wait. A position
        whose tokens have changed since it was put there is stale and skipped.
        """
        first, get = self.first, self.ranks.get
        ids = [first[b] for b in data]
        size = len(ids)
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        filled = 0

        def push(rank: int, position: int) -> None:
            nonlocal filled
            if rank in buckets:
                buckets[rank].append(position)
                return
            buckets[rank] = [position]
            word = rank >> 6
            if word in words:
                words[word] |= 1 << (rank & 63)
            else:
                words[word] = 1 << (rank & 63)
                filled |= 1 << word

        for i, pair in enumerate(zip(ids, ids[1:])):
            if found := get(pair):
                push(found[0], i)
        if not filled:
            return ids
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while filled:
            word = (filled & -filled).bit_length() - 1
            bits = words[word]
            lowest = bits & -bits
            rank = word << 6 | lowest.bit_length() - 1
            if bits == lowest:
                del words[word]
                filled ^= 1 << word
            else:
                words[word] = bits ^ lowest
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()  # equal ranks are merged from left to right
            for k, i in enumerate(positions):
                j = after[i]
                if ids[i] < 0 or j >= size:
                    continue  # stale: the token went into its left neighbour, or lost its right one
                found = get((ids[i], ids[j]))
                if found is None or found[0] != rank:
                    continue  # stale: another merge has changed one of the two
                made = ids[i] = found[1]
                ids[j] = -1
                n = after[i] = after[j]
                p, sooner = before[i], False
                if n < size:
                    before[n] = i
                    if found := get((made, ids[n])):
                        push(found[0], i)
                        sooner = found[0] < rank
                if p >= 0 and (found := get((ids[p], made))):
                    push(found[0], p)
                    sooner |= found[0] < rank
                if sooner:  # only in vocabularies whose merges aren't in the order of their making
                    for left in positions[k + 1 :]:
                        push(rank, left)
                    break
        return [x for x in ids if x >= 0]

    def encode(self, text: str):
        """An iterator over the ids of a text; spellings of special tokens are ordinary text."""
        return chain.from_iterable(map(self.__getitem__, self.pieces(text)))
