"""Vectorised hashes of substrings, words and word shingles, over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20)
_BYTES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _powers(n: int) -> list[np.ndarray]:
    """For each base its powers and those of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in _BASES:
            for factor in (base, np.uint64(pow(int(base), -1, 1 << 64))):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS


class RollingHash:
    """Hashes of any substrings of ``data`` at once; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, which: int):
        n = len(data)
        powers = _powers(max(n + 1, (1 << 18) + 1024))
        self.inverse = powers[2 * which + 1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * powers[2 * which][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]


def _word_bytes(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte to byte with A-Z in lower case, whether a byte belongs to words)."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    letter = np.ones(256, bool)
    letter[list(separators)] = False
    return fold, letter


#: Words of anything but space and the controls 9 to 13.
BY_SPACE = _word_bytes(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of ASCII letters, digits and all bytes beyond ASCII.
BY_PUNCTUATION = _word_bytes(bytes(b for b in range(128) if not chr(b).isalnum()))


def groups_of(texts: list[bytes], size: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of about ``size`` bytes; a longer text is alone."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield begin, texts[begin:i]
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def word_hashes(texts: list[bytes], kind: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text and in all); ``kind`` is BY_SPACE or BY_PUNCTUATION."""
    fold, letters = kind
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    change = np.diff(letters[data].view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return mix(RollingHash(fold[data], 0).of(start, end)), np.searchsorted(start, begins)


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle in order, number before each text and in all); a text of fewer words has one shingle of all of them, none without words."""
    n = np.diff(counts)
    have = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(have)])
    text = np.repeat(np.arange(len(n)), have)
    first = np.arange(before[-1]) - before[:-1][text] + counts[:-1][text]
    length = np.minimum(n[text], size)
    out = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        part = out * np.uint64(0x2545F4914F6CDD1D) + padded[first + k]
        out = part if size == 1 else np.where(k < length, part, out)
    return mix(out), before


def sets_of(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted, and the number before each text and in all."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(len(before)))
