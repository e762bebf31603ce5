"""Words and hashes of many texts at once, on the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: ASCII white space that separates words.
SPACE = b" \t\n\x0b\x0c\r"
#: At most so many bytes of text are worked on at a time.
BLOCK = 1 << 20

_U = np.uint64
_P = (_U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95))
_Q = (_U(0xBF58476D1CE4E5B9), _U(0x2545F4914F6CDD1D))

IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACE)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + (1 << 16))
        p = int(_P[which])
        tables = []
        for base in (p, pow(p, -1, 1 << 64)):
            t = np.full(size, base, _U)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        have = _powers[which] = tuple(tables)
    return have


class Rolling:
    """Hashes of any ranges of one byte array."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which = which
        up, self.down = _power_tables(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(_U) * _Q[self.which])

    def windows(self, n: int) -> np.ndarray:
        """The hash of each n bytes, by start."""
        m = len(self.sums) - n
        if m <= 0:
            return np.empty(0, _U)
        return mix((self.sums[n:] - self.sums[:m]) * self.down[:m] + _U(n * int(_Q[self.which]) % (1 << 64)))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets between them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(off):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(lengths: np.ndarray, most: int = BLOCK):
    """(first, last + 1) of runs of rows with about ``most`` bytes together; a longer row stands alone."""
    ends = np.cumsum(lengths)
    first, n = 0, len(lengths)
    while first < n:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words never cross rows."""
    m = is_word[data]
    if not m.any():
        z = np.empty(0, np.int64)
        return z, z, z
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    filled = offsets[1:] > offsets[:-1]
    at = offsets[:-1][filled]
    first[at] = m[at]
    at = offsets[1:][filled] - 1
    last[at] = m[at]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def sequence_hash(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """The hash of each n consecutive values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, _U)
    out = np.zeros(m, _U)
    for j in range(n):
        out = out * _Q[which] + h[j : j + m]
    return mix(out + _U(n))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, in a row."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = length > 0
    s, n = start[keep].astype(np.int64), length[keep].astype(np.int64)
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of each run of equal keys."""
    if not len(keys):
        return []
    first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]).tolist()
    return list(zip(first, [*first[1:], len(keys)], strict=True))
