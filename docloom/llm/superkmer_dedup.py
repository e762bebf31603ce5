"""Substring dedup over words by super-k-mer partitioning.

Every window of 13 consecutive words goes to the bucket of its minimiser (the five words in it with
the smallest hash); consecutive windows that share one travel as one packed string. In a bucket the
windows are sorted by a 64-bit hash of their words, which counts equal windows, and those that also
start in a document with a smaller id are covered, once their words have been compared with those of that
document. Windows are judged on the input.

Null and empty texts, and those of fewer words, have no windows and lose nothing. Repeated rows with
one id do not cover each other. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from docloom.llm import _text, _windows


def _same_words(body: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each word of a are those from the word of b."""
    if not len(a):
        return np.empty(0, bool)
    i, j = (a[:, None] + np.arange(n)).ravel(), (b[:, None] + np.arange(n)).ravel()
    same = size[i] == size[j]
    at = np.flatnonzero(same)
    same[at] = _windows._equal_bytes(body, start[i[at]], start[j[at]], size[i[at]])
    return same.reshape(-1, n).all(1)


def _by_words(body: np.ndarray, start: np.ndarray, size: np.ndarray, word: np.ndarray, h: np.ndarray, doc: np.ndarray, hashes: np.ndarray, asked: np.ndarray, n: int) -> np.ndarray:
    """Of the asked windows, those that a smaller document has: for the few hashes that different windows share."""
    text = lambda w: tuple(body[start[x] : start[x] + size[x]].tobytes() for x in range(word[w], word[w] + n))
    least: dict = {}
    for w in np.flatnonzero(np.isin(h, hashes)).tolist():
        key = text(w)
        least[key] = min(least.get(key, doc[w]), doc[w])
    return np.array([w for w in asked.tolist() if least[text(w)] < doc[w]], np.int64)


def _covered(n: int):
    def covered(ids, pos, units, length, anchor, body):
        larger, kept = _windows.settle_equal(ids, length, body)
        whole = np.flatnonzero(larger)
        begin = np.cumsum(length) - length
        hashes, strings, at, words = [], [], [], []
        for first, last in _text.blocks(length[kept]):
            mine = kept[first:last]
            data = body[_text.ragged(begin[mine], length[mine])]
            offsets = np.concatenate([[0], np.cumsum(length[mine])])
            s, e, row = _text.words(data, offsets)
            h = _text.sequence_hash(_text.Rolling(data).ranges(s, e), n)
            ok = np.flatnonzero(row[: len(h)] == row[n - 1 :]) if len(h) else np.empty(0, np.int64)
            hashes.append(h[ok])
            strings.append(mine[row[ok]])
            first_word = np.searchsorted(row, np.arange(len(mine)))
            at.append(pos[mine[row[ok]]] + ok - first_word[row[ok]])
            # where the words of each window are in ``body``
            shift = (begin[mine] - offsets[:-1])[row]
            words.append((s + shift, e - s, ok))
        if not hashes:
            return whole, pos[whole], pos[whole] + units[whole]
        word_start, word_size = (np.concatenate([w[i] for w in words]) for i in (0, 1))
        shift = np.cumsum([0, *(len(w[0]) for w in words[:-1])])
        word = np.concatenate([w[2] + x for w, x in zip(words, shift.tolist(), strict=True)])
        h, string, at = np.concatenate(hashes), np.concatenate(strings), np.concatenate(at)
        doc = ids[string]
        order = np.lexsort((doc, h))
        head = np.ones(len(order), bool)
        head[1:] = h[order][1:] != h[order][:-1]
        first = order[head][np.cumsum(head) - 1] if len(order) else order
        hit = doc[order] > doc[first]
        hit, first = order[hit], first[hit]
        same = _same_words(body, word_start, word_size, word[hit], word[first], n)
        sure = hit[same]
        if not same.all():
            sure = np.concatenate([sure, _by_words(body, word_start, word_size, word, h, doc, np.unique(h[hit[~same]]), hit[~same], n)])
        hit = np.sort(sure)
        which, a, b = _windows.spans_of(string[hit], at[hit], n)
        return np.concatenate([whole, which]), np.concatenate([pos[whole], a]), np.concatenate([pos[whole] + units[whole], b])

    return covered


def remove_repeated_words(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 13, k: int = 5, with_text: bool = True) -> DataFrame:
    """``docs`` without the words covered by a window of ``n`` words that also starts in a document with a smaller id.

    Adds n_units (words), n_removed, n_spans and kept_sha256 (of the kept words, joined by one
    space); columns of these names are replaced. A text that loses words is returned as its kept
    words joined by one space; other texts stay as they are.
    """
    return _windows.remove_repeats(docs, id, text, n, k, _covered(n), True, with_text)
