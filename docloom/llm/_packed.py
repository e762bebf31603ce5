"""Arrays of numbers as one compressed value."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of one-byte or eight-byte numbers; the bytes of equal weight stand together."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.itemsize)]], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + planes)


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for (length, width), t in zip(sizes.tolist(), types, strict=True):
        planes = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += length * width
    return out
