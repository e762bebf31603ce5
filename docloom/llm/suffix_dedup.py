"""Substring dedup over bytes with a logarithmic family of suffix arrays.

The suffixes of all texts are partitioned by the minimiser of their first 50 bytes, so suffixes that
share 50 bytes meet in one bucket, packed in strings of neighbouring suffixes. A bucket takes its strings
in batches in the order of their documents. A batch gets a suffix array (its suffixes sorted by their
first 50 bytes); its suffixes are looked up in order in the existing levels, which hold the suffixes of smaller
documents, for matches of 50 bytes; then it becomes a level itself, and levels of equal size merge (two
sorted arrays into one), so that their sizes grow geometrically. Strings that equal another one as a whole are settled before, and
suffixes of which no other has the same 64-bit hash are left out of the arrays, as they match nothing.

Null texts are empty; texts of fewer bytes have no matches. Repeated rows with one id do not cover each
other. Matches never cross documents. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from docloom.llm import _text, _windows

#: Suffixes in a batch.
BATCH = 1 << 14


class SuffixArrays:
    """Levels of suffix arrays: the distinct first n bytes of suffixes, sorted, with the smallest document of each."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def array(suffixes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(suffixes, kind="stable")
        suffixes, docs = suffixes[order], docs[order]
        head = np.ones(len(order), bool)
        head[1:] = suffixes[1:] != suffixes[:-1]
        return suffixes[head], np.minimum.reduceat(docs, np.flatnonzero(head))

    @staticmethod
    def scanned(level: tuple[np.ndarray, np.ndarray], suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted suffixes stand in a level, and whether it holds them: a binary search from one to the next."""
        at = np.searchsorted(level[0], suffixes)
        return at, level[0][np.minimum(at, len(level[0]) - 1)] == suffixes

    def least(self, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The smallest document with each of the sorted suffixes in the levels; its own where there is none."""
        out = docs.copy()
        for level in self.levels:
            at, held = self.scanned(level, suffixes)
            out[held] = np.minimum(out[held], level[1][at[held]])
        return out

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> None:
        """Sorted, distinct suffixes become a level; levels of equal size merge, without sorting anew."""
        new = suffixes, docs
        while self.levels and len(self.levels[-1][0]) <= len(new[0]):
            old = self.levels.pop()
            at, held = self.scanned(old, new[0])
            by = old[1].copy()
            by[at[held]] = np.minimum(by[at[held]], new[1][held])
            new = np.insert(old[0], at[~held], new[0][~held]), np.insert(by, at[~held], new[1][~held])
        self.levels.append(new)


def _covered(n: int, k: int):
    def covered(ids, pos, units, length, anchor, body):
        larger, kept = _windows.settle_equal(ids, length, body)
        whole = np.flatnonzero(larger)
        begin = np.cumsum(length) - length
        # strings whose minimiser no other document's string has match nothing
        grams = np.empty(len(kept), np.uint64)
        for first, last in _text.blocks(length[kept]):
            mine = kept[first:last]
            at = np.concatenate([[0], np.cumsum(length[mine])])[:-1] + anchor[mine]
            grams[first:last] = _text.Rolling(body[_text.ragged(begin[mine], length[mine])]).ranges(at, at + k)
        order = np.lexsort((ids[kept], grams))
        head = np.ones(len(order), bool)
        head[1:] = grams[order][1:] != grams[order][:-1]
        group = np.cumsum(head) - 1
        doc = ids[kept][order]
        shared = np.zeros(len(kept), bool)
        if len(order):
            starts = np.flatnonzero(head)
            shared[order] = (np.maximum.reduceat(doc, starts) > np.minimum.reduceat(doc, starts))[group]
        kept = kept[shared]
        hashes, strings, offset = [], [], []
        for first, last in _text.blocks(length[kept]):
            mine = kept[first:last]
            data = body[_text.ragged(begin[mine], length[mine])]
            edge = np.cumsum(length[mine])
            h = _text.Rolling(data).windows(n)
            count = length[mine] - n + 1
            ok = _text.ragged(edge - length[mine], count)
            hashes.append(h[ok])
            strings.append(np.repeat(mine, count))
            offset.append(_text.ragged(np.zeros(len(mine), np.int64), count))
        if not hashes:
            return whole, pos[whole], pos[whole] + units[whole]
        h, string, offset = np.concatenate(hashes), np.concatenate(strings), np.concatenate(offset)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        left = order[twice]
        left = left[np.argsort(ids[string[left]], kind="stable")]
        docs = ids[string[left]]
        family, hit = SuffixArrays(), []
        for a in range(0, len(left), BATCH):
            mine, by = left[a : a + BATCH], docs[a : a + BATCH]
            start = begin[string[mine]] + offset[mine]
            suffixes = np.ascontiguousarray(body[start[:, None] + np.arange(n)]).view(f"S{n}").ravel()
            keys, least = family.array(suffixes, by)
            before = np.minimum(least, family.least(keys, least))
            hit.append(mine[before[np.searchsorted(keys, suffixes)] < by])
            family.add(keys, least)
        hit = np.sort(np.concatenate(hit)) if hit else np.empty(0, np.int64)
        which, a, b = _windows.spans_of(string[hit], pos[string[hit]] + offset[hit], n)
        return np.concatenate([whole, which]), np.concatenate([pos[whole], a]), np.concatenate([pos[whole] + units[whole], b])

    return covered


def remove_repeated_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 50, k: int = 16, with_text: bool = True) -> DataFrame:
    """``docs`` without the bytes covered by a string of ``n`` bytes that also starts in a document with a smaller id.

    Adds n_units (bytes), n_removed, n_spans and kept_sha256 (of the kept bytes); columns of
    these names are replaced. A kept text is decoded again without the bytes of characters that
    a removal has cut.
    """
    return _windows.remove_repeats(docs, id, text, n, k, _covered(n, k), False, with_text)
