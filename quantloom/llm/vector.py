"""Words of many texts at once, as numpy arrays: places, 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
_M = (1 << 64) - 1
#: Texts are taken together up to so many bytes; a longer text stands alone.
BLOCK = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base & _M))
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return [_powers[0][:n], _powers[1]]


def forget() -> None:
    """Drop the powers, which are as long as the longest block so far."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@dataclass
class Words:
    """Words of a list of texts; ``first[d]`` to ``first[d + 1]`` are those of text d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_starts: np.ndarray
    prefix: np.ndarray

    def hashes(self, most: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``most`` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        with np.errstate(over="ignore"):
            return mix((self.prefix[ends] - self.prefix[self.starts]) * _powers[1][self.starts] + (ends - self.starts).astype(np.uint64))

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: list[bytes], spaces: bytes = SPACES) -> Words:
    """Split texts at the given bytes."""
    is_space = np.zeros(256, bool)
    is_space[list(spaces)] = True
    gap = spaces[:1]
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_starts = np.concatenate([[0], np.cumsum(lengths)]) + 1
    space = is_space[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    up, _ = _power(len(data))
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up, dtype=np.uint64)])
    return Words(data, starts, ends, np.searchsorted(starts, text_starts), text_starts, prefix)


def sliced(batches, rows: int = 1024):
    """The batches in slices of few rows, so that few texts are unpacked at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def blocks(texts: list[bytes], limit: int = BLOCK, others: list[bytes] | None = None):
    """(low, high) ranges of texts, and of others beside them, of about ``limit`` bytes."""
    low = size = 0
    for k, t in enumerate(texts):
        n = len(t) + (len(others[k]) if others else 0)
        if size and size + n > limit:
            yield low, k
            low, size = k, 0
        size += n
    if low < len(texts):
        yield low, len(texts)


def runs(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of every run of k words inside one text; a text with fewer words is one run, one without words none."""
    counts = np.diff(first)
    k_of = np.minimum(counts, k)
    n = np.where(counts > 0, counts - k_of + 1, 0)
    at = np.arange(n.sum()) + np.repeat(first[:-1] - (np.cumsum(n) - n), n)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = np.repeat(k_of, n) > j
            step = np.where(inside, hashes[np.minimum(at + j, max(len(hashes) - 1, 0))], np.uint64(0)) if len(hashes) else out
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(j + 1))
    return out, at
