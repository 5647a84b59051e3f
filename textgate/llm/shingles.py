"""Hashed word shingles of many texts at once, in numpy.

Words are runs of `[^\\x20\\x09-\\x0D]` of the text with A-Z lower-cased. A text's set holds the 64-bit hashes of its
distinct runs of WORDS words; a text of fewer words has its whole sequence as one; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.int64).astype(_U)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = np.random.default_rng(21).integers(1, 1 << 63, WORDS, np.int64).astype(_U) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers that scatters them."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_RADIX, _INVERSE)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers


def sets(texts: list[str | None], part_bytes: int = 1 << 18) -> list[np.ndarray]:
    """For each text its shingle hashes, sorted and distinct (uint64)."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        part.append(raw)
        size += len(raw) + 1
        if size >= part_bytes:
            out += _sets(part)
            part, size = [], 0
    return out + (_sets(part) if part else [])


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    up, down = _power(len(raw) + 1)
    word = ~_SPACE[raw]
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=_U, out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    first = np.searchsorted(starts, np.concatenate([[0], ends_of_text]))
    n = max(0, len(words) - WORDS + 1)
    runs = np.zeros(n, _U)
    for k in range(WORDS):
        runs += words[k : k + n] * _PLACE[k]
    runs = mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            found = np.sort(runs[a : b - WORDS + 1])  # np.unique hashes, which is slower here
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            out.append(mix(np.array([sum(int(w) * int(p) for w, p in zip(words[a:b], _PLACE)) + (b - a) & (1 << 64) - 1], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def first_in_order(tokens: np.ndarray, order: int, n: int) -> np.ndarray:
    """The first n of sorted, distinct tokens under a hash order (1, 2, ...), themselves sorted by value."""
    place = mix(tokens ^ _U(0xA0761D6478BD642F * order & (1 << 64) - 1))
    return tokens[place <= np.partition(place, n - 1)[n - 1]]
