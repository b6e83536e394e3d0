"""Vectorised 64-bit hashes of words and of word windows, for use inside tasks.

Texts are laid into one byte buffer with a blank between them, so that a task makes a few array passes
over about a megabyte and not one Python call a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

BUFFER_BYTES = 1 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP2 = np.uint64(0xA0761D6478BD642F)
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: Mask of the first n bytes of a lane of eight.
_KEEP = np.array([*((1 << 8 * n) - 1 for n in range(8)), (1 << 64) - 1], dtype=np.uint64)
#: Blank bytes at the end of a buffer, so that a lane can be read at every word.
PAD = b" " * 8
_LONG = 2048


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte buffer."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_BLANK[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word: eight at a time are mixed into it. `data` ends with PAD."""
    size = ends - starts
    h = mix(size.astype(np.uint64) + _SEED)
    lanes = np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    rows = np.flatnonzero(size <= _LONG)
    at, left = starts[rows], size[rows]
    while len(rows):
        h[rows] = mix((h[rows] ^ (lanes[at] & _KEEP[np.minimum(left, 8)])) + _SEED)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for row in np.flatnonzero(size > _LONG):
        h[row] = xxhash.xxh64_intdigest(data[starts[row] : ends[row]].tobytes())
    return h


def hash_windows(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """A hash for each run of k consecutive entries."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    step, weight, total = (_STEP2 if second else _STEP), np.uint64(1), np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for t in range(k):
            total += words[t : t + n] * weight
            weight = np.uint64((int(weight) * int(step)) & 0xFFFFFFFFFFFFFFFF)
    return mix(total)


class Batch:
    """Some whole texts: where their words lie, the words' hashes and the text of each word."""

    def __init__(self, rows: list[int], texts: list[bytes]):
        self.rows = rows
        self.data = np.frombuffer(b" ".join([*texts, PAD]), dtype=np.uint8)
        self.starts, self.ends = spans(self.data)
        self.words = hash_words(self.data, self.starts, self.ends)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.first_word = np.searchsorted(self.starts, begins)  # of text t, and one past the last
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first_word))

    def windows(self, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every window that lies within one text."""
        n = len(self.words) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, hash_windows(self.words, k, second)[at]

    def covered(self, at: np.ndarray, k: int) -> np.ndarray:
        """Which words lie in one of the windows that start at `at`."""
        n = len(self.words) + 1
        edge = np.bincount(at, minlength=n) - np.bincount(at + k, minlength=n)
        return np.cumsum(edge[:-1]) > 0


def batches(texts) -> Iterator[Batch]:
    """Batches of about BUFFER_BYTES over an iterable of str, UTF-8 bytes or None; a longer text is a batch of its own."""
    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
        if held and size + len(data) > BUFFER_BYTES:
            yield Batch(rows, held)
            rows, held, size = [], [], 0
        rows.append(row)
        held.append(data)
        size += len(data) + 1
    if held:
        yield Batch(rows, held)
