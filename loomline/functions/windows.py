"""k-mers of byte strings as packed numbers, whole arrays at a time (numpy); helpers of tasks that read Arrow batches."""

from __future__ import annotations

import numpy as np

#: Code of a byte that is no base, and of the place before a sequence or after it.
OTHER, NONE = 4, 5
EDGE = ord("$")
_CODES = np.full(256, OTHER, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_CODES[EDGE] = NONE
#: Bit of a code as a neighbour; what is no base counts as an end.
BIT = np.array([1, 2, 4, 8, 16, 16], np.uint8)
_TURNED = np.array([3, 2, 1, 0, OTHER, NONE], np.uint8)


def codes_of(data: bytes | np.ndarray) -> np.ndarray:
    return _CODES[np.frombuffer(data, np.uint8)]


def packed(codes: np.ndarray, k: int, turned: bool = False) -> np.ndarray:
    """The number, two bits a base, of every k bases in a row; turned: of their reverse complement.

    Windows of 1, 2, 4, ... bases are joined, so that the work grows with log k. Codes that are no base give any number.
    """
    part = (np.uint64(3) - (codes & 3) if turned else codes & 3).astype(np.int64)
    made, have, width = None, 0, 1
    while True:
        if k & width:
            if made is None:
                made, have = part, width
            else:  # the windows that made holds begin behind those of part
                first, rest = part[: len(codes) - have - width + 1], made[width:]
                made = (rest << 2 * width) | first if turned else (first << 2 * have) | rest
                have += width
        if have == k:
            return made
        low, high = part[width:], part[:-width] if len(part) > width else part[:0]
        part = (low << 2 * width) | high if turned else (high << 2 * width) | low
        width *= 2


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every width values in a row."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def scrambled(values: np.ndarray) -> np.ndarray:
    """A fixed hash of numbers, 32 bits, so that minimizers are no runs of A."""
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def whole(codes: np.ndarray, k: int) -> np.ndarray:
    """Whether every k codes in a row are bases."""
    seen = np.concatenate(([0], np.cumsum(codes > 3)))
    return seen[k:] == seen[:-k]


class KmerWindows:
    """All k-mers of data that are bases only and have a byte on either side: at (their places), vertex, strand, neighbours.

    vertex is the packed canonical k-mer plus one; before and after are the codes of the neighbours as data reads,
    entering and leaving those of the canonical strand.
    """

    def __init__(self, codes: np.ndarray, k: int, inside: np.ndarray | None = None) -> None:
        n = len(codes) - k - 1
        fits = whole(codes, k)[1 : n + 1] if n > 0 else np.zeros(0, bool)
        if inside is not None:
            fits &= inside[1 : n + 1]
        self.at = np.flatnonzero(fits) + 1
        forward = packed(codes, k)[self.at] if n > 0 else np.zeros(0, np.int64)
        back = packed(codes, k, True)[self.at] if n > 0 else np.zeros(0, np.int64)
        self.strand = np.where(forward < back, 1, -1)
        self.vertex = np.minimum(forward, back) + 1
        self.before, self.after = codes[self.at - 1], codes[self.at + k]
        plus = self.strand > 0
        self.entering = np.where(plus, self.before, _TURNED[self.after])
        self.leaving = np.where(plus, self.after, _TURNED[self.before])


def summed(vertex: np.ndarray, entering: np.ndarray, leaving: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each vertex once, with the bits of its neighbours joined and n added up."""
    if not len(vertex):
        return vertex, entering, leaving, n
    order = np.argsort(vertex)
    vertex = vertex[order]
    first = np.flatnonzero(np.concatenate(([True], vertex[1:] != vertex[:-1])))
    return vertex[first], np.bitwise_or.reduceat(entering[order], first), np.bitwise_or.reduceat(leaving[order], first), np.add.reduceat(n[order], first)
