"""Many texts as one array of code points, with hashes of any of their spans in constant time each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_STEP, _BACK = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, U), np.ones(1, U)]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2^64, kept between calls."""
    if len(_POWERS[0]) < size:
        for i, base in enumerate((_STEP, _BACK)):
            grown = np.full(size, base, U)
            grown[0] = 1
            _POWERS[i] = np.cumprod(grown)
    return _POWERS[0][:size], _POWERS[1][:size]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of a polynomial's value over the whole word."""
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(32))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(29))


class Spans:
    """Hashes of spans of a sequence of numbers by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, values: np.ndarray) -> None:
        self.power, self.back = powers(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, U)
        np.cumsum((values + U(1)) * self.power[:-1], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the spans from ``start`` to before ``end``."""
        return mixed((self.prefix[end] - self.prefix[start]) * self.back[start])

    def every(self, width: int) -> np.ndarray:
        """Of the spans of ``width`` at every position."""
        n = len(self.prefix) - width
        return mixed((self.prefix[width:] - self.prefix[:n]) * self.back[:n])


def gathered(rows: Iterable[tuple[object, str]], limit: int = 1 << 19) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts in groups of about ``limit`` characters; a longer text is a group by itself."""
    keys, texts, size = [], [], 0
    for key, text in rows:
        if size and size + len(text) > limit:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(text)
        size += len(text)
    if keys:
        yield keys, texts


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text begins, with the end at last."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, in three passes whatever the width."""
    if len(values) < width:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])
