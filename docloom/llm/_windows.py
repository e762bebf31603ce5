"""What repeats across documents, found by partitioning all windows of all texts by their minimisers.

A window is n consecutive units (bytes or words) of one document. The minimiser of a window is the k units
in it with the smallest hash, so equal windows have equal minimisers at equal places.

1. Documents are dealt to groups. A group sends each of its minimisers once, with its smallest document and
   the number of its documents, to the minimiser's bucket. A minimiser that occurs in one document only has no
   window that occurs in another, so those windows are done. The other minimisers go back to their groups.
2. Windows that follow one another and share such a minimiser travel together as one string to its bucket.
   Before that, equal strings of a group are settled where they are: only that of the smallest document
   travels on, the others are covered already, and their spans go home by way of buckets that are chosen for
   the group. The windows of a minimiser of more than HOT documents travel one by one, dealt by what is in
   them, so a hot minimiser is split over all buckets.
3. A bucket says which windows of a document also start in a smaller document. Those spans go back to their
   documents, where units are removed.

Hashes find equal strings and windows; what they find is compared byte by byte before it counts. Documents are
known by a 64-bit hash of id and text, so repeated rows are judged alike; a null id counts
as larger than every other and never covers another null id. Nothing here holds more than one batch, one
bucket or one group of documents; their number follows the bytes of the texts. Each group writes to each bucket, so
small groups and buckets make values that are many and compress badly, whatever tasks read the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import _packed, _shared, _text

#: A minimiser of more documents is hot.
HOT = 20_000
#: Strings of about so many bytes are settled and sent together.
FLUSH = 32 << 20
#: A task deals documents of about so many bytes to their groups together.
DEALT = 64 << 20
#: A group's documents are put together again from about so many bytes at a time.
FINISHED = 2 << 20
#: Bytes of text for each bucket of minimisers, bucket of strings, and group of documents; and how many of each there are at least.
ANCHOR_BUCKET = 16 << 20
BUCKET = 8 << 20
GROUP = 16 << 20
FEWEST = 8

_ANCHOR_TYPES = (np.int64, np.int64, np.uint32, np.uint32, np.uint8, np.uint64)
_REPEAT_TYPES = (np.uint64, np.uint8)
_STRING_TYPES = (np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8, np.uint32, np.uint32, np.uint32)
_SPAN_TYPES = (np.int64, np.int64, np.uint32, np.uint32, np.uint32)


def _pack(types: tuple, *arrays: np.ndarray, level: int = 1) -> bytes:
    return _packed.pack(*[np.ascontiguousarray(a, t) for a, t in zip(arrays, types, strict=True)], level=level)


def _minimisers(h: np.ndarray, width: int) -> np.ndarray:
    """The position of the smallest of each ``width`` hashes, the leftmost of equal ones."""
    bits = np.uint64((1 << max(1, int(len(h)).bit_length())) - 1)
    m = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    if done < width:
        m = np.minimum(m[: len(m) - (width - done)], m[width - done :])
    return (m & bits).astype(np.int64)


def _runs(valid: np.ndarray, at: np.ndarray, alone: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of valid windows with one minimiser; windows that go ``alone`` are runs of their own."""
    i = np.flatnonzero(valid)
    if not len(i):
        return i, i
    cut = (np.diff(i) != 1) | (np.diff(at[i]) != 0)
    if alone is not None:
        cut |= alone[i[1:]] | alone[i[:-1]]
    new = np.flatnonzero(cut) + 1
    return i[np.concatenate([[0], new])], i[np.concatenate([new - 1, [len(i) - 1]])]


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones that are wanted."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def byte_strings(data: np.ndarray, offsets: np.ndarray, n: int, k: int, hot: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """row, position and number of units, start and end byte, anchor and hash of the minimiser, string hash, what it is dealt by.

    Only row and the minimiser's hash if it is not said which minimisers are ``hot``.
    """
    a, total = 0, len(data)
    ends = offsets[1:]
    while a + n <= total:
        b = min(total, a + _text.BLOCK + n - 1)
        part = data[a:b]
        roll = _text.Rolling(part)
        grams = roll.windows(k)
        at = _minimisers(grams, n - k + 1)
        i = np.arange(a, b - n + 1)
        row_of_edges = np.searchsorted(ends, [a, b - n], "right")
        near = ends[row_of_edges[0] : row_of_edges[1] + 1]
        sizes = np.diff(np.concatenate([[a], np.minimum(near, b - n + 1)]))
        valid = i + n <= np.repeat(near, np.maximum(sizes, 0))[: len(i)]
        alone = _among(grams[at], hot) if hot is not None and len(hot) else None
        f, z = _runs(valid, at, alone)
        if len(f):
            end = z + n
            row = np.searchsorted(ends, f + a, "right")
            if hot is not None:
                gram, string = grams[at[f]], roll.ranges(f, end)
                yield row, f + a - offsets[row], end - f, f + a, end + a, at[f] - f, gram, string, gram if alone is None else np.where(alone[f], string, gram)
            else:
                yield row, grams[at[f]]
        a += _text.BLOCK


def word_strings(data: np.ndarray, offsets: np.ndarray, n: int, k: int, hot: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """As byte_strings, with words for units."""
    s, e, row = _text.words(data, offsets)
    if not len(s):
        return
    first_word = np.searchsorted(row, np.arange(len(offsets) - 1))
    a = 0
    while a + n <= len(s):
        b = min(len(s), max(a + 2 * n, int(np.searchsorted(s, s[a] + _text.BLOCK))))
        part = data[s[a] : e[b - 1]]
        roll = _text.Rolling(part)
        h = roll.ranges(s[a:b] - s[a], e[a:b] - s[a])
        grams = _text.sequence_hash(h, k)
        at = _minimisers(grams, n - k + 1)
        valid = row[a : b - n + 1] == row[a + n - 1 : b]
        alone = _among(grams[at], hot) if hot is not None and len(hot) else None
        f, z = _runs(valid, at, alone)
        if len(f):
            last = z + n - 1
            r = row[f + a]
            start, end = s[f + a], e[last + a]
            if hot is not None:
                gram = grams[at[f]]
                deal = gram if alone is None else np.where(alone[f], _text.sequence_hash(h, n)[f], gram)
                yield r, f + a - first_word[r], last - f + 1, start, end, at[f] - f, gram, roll.ranges(start - s[a], end - s[a]), deal
            else:
                yield r, grams[at[f]]
        if b == len(s):
            return
        a = b - n + 1


class _Batch:
    """The strings of some documents, until they are sent."""

    def __init__(self, n_buckets: int, home: int):
        self.n_buckets, self.home = n_buckets, home
        self.docs: list[np.ndarray] = []
        self.parts: list[tuple] = []
        self.n_docs = self.size = 0

    def add(self, data: np.ndarray, found: tuple[np.ndarray, ...]) -> None:
        row, pos, units, start, end, anchor, _, string, deal = found
        body = data[_text.ragged(start, end - start)]
        self.parts.append((row + self.n_docs, pos, units, end - start, anchor, (deal % np.uint64(self.n_buckets)).astype(np.int64), string, body))
        self.size += len(body)

    def close_rows(self, docs: np.ndarray) -> None:
        self.docs.append(docs)
        self.n_docs += len(docs)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        if self.parts:
            docs = np.concatenate(self.docs)
            doc, pos, units, length, anchor, bucket, string, body = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            begin = np.cumsum(length) - length
            settled = _settled(docs["id"][doc], string, length, body)
            none = np.empty(0, np.int64)

            def row(to: int, sent: np.ndarray, known: np.ndarray) -> tuple[int, bytes]:
                used, local = np.unique(doc[np.concatenate([sent, known])], return_inverse=True)
                t = docs[used]
                text = body[_text.ragged(begin[sent], length[sent])]
                k = len(sent)
                return to, _pack(_STRING_TYPES, t["id"], t["key"], local[:k], pos[sent], units[sent], length[sent], anchor[sent], text, local[k:], pos[known], pos[known] + units[known], level=3)

            travel = np.flatnonzero(~settled)
            by = travel[np.argsort(bucket[travel], kind="stable")]
            for a, b in _text.runs(bucket[by]):
                yield row(int(bucket[by[a]]), by[a:b], none)
            if settled.any():
                yield row(self.home % self.n_buckets, none.astype(np.int64), np.flatnonzero(settled))
        self.__init__(self.n_buckets, self.home)


_DOC = np.dtype([("id", np.int64), ("key", np.int64)])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dest, ...) to their groups: the rows of one group as one compressed table."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))

    def sent(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        dests = [batch.column("dest").to_numpy() for batch in held]
        rows = [batch.drop_columns(["dest"]) for batch in held]
        keys, blobs = [], []
        # the rows of one group are copied at a time, never all again
        for dest in np.unique(np.concatenate(dests)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema, options=options) as out:
                out.write_table(pa.Table.from_batches([r.take(pa.array(np.flatnonzero(d == dest))) for r, d in zip(rows, dests, strict=True)]).combine_chunks())
            keys.append(int(dest))
            blobs.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["dest", "blob"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= DEALT:
            yield sent(held)
            held, size = [], 0
    if held:
        yield sent(held)


def _opened(table: pa.Table) -> pa.Table:
    """The documents of a group."""
    return pa.concat_tables([pa.ipc.open_stream(blob).read_all() for blob in table["blob"].to_pylist()])


def _docs_of(table: pa.Table) -> np.ndarray:
    docs = np.empty(table.num_rows, _DOC)
    for name in ("id", "key"):
        docs[name] = table[name].to_numpy()
    return docs


def _anchors(strings: Callable, n: int, k: int, n_buckets: int):
    """Of one group of documents: its distinct minimisers, each with its smallest document, to their buckets."""

    def run(group: pa.Table) -> pa.Table:
        table = _opened(group)
        docs = _docs_of(table)
        data, offsets = _text.flat(table["text"])
        rows, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for row, gram in strings(data, offsets, n, k, None):
            rows.append(row)
            grams.append(gram)
        row, gram = np.concatenate(rows), np.concatenate(grams)
        keys, blobs = [], []
        if len(row):
            order = np.lexsort((row, docs["id"][row], gram))
            row, gram = row[order], gram[order]
            head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            other = np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])])
            ids = docs["id"][row]
            several = ids[np.concatenate([head[1:], [len(row)]]) - 1] > ids[head]
            count = np.add.reduceat(other.astype(np.int64), head)
            least, gram = row[head], gram[head]
            bucket = (gram % np.uint64(n_buckets)).astype(np.int64)
            by = np.lexsort((gram, bucket))
            home = np.array([group["dest"][0].as_py()], np.int64)
            for a, b in _text.runs(bucket[by]):
                mine = by[a:b]
                used, local = np.unique(least[mine], return_inverse=True)
                keys.append(int(bucket[mine[0]]))
                blobs.append(_pack(_ANCHOR_TYPES, home, docs["id"][used], local, count[mine], several[mine], np.diff(gram[mine], prepend=np.uint64(0))))
        return pa.table([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _repeated(most: int):
    """Of one bucket: the minimisers that occur in several documents, and whether in more than ``most``, to the groups that hold them."""

    def run(table: pa.Table) -> pa.Table:
        homes, ids, counts, several, grams = [], [], [], [], []
        for blob in table["blob"].to_pylist():
            home, names, local, count, more, gram = _packed.unpack(blob, *_ANCHOR_TYPES)
            homes.append(np.full(len(gram), home[0]))
            ids.append(names[local])
            counts.append(count.astype(np.int64))
            several.append(more.astype(bool))
            grams.append(np.cumsum(gram, dtype=np.uint64))
        home, id, count, more, gram = (np.concatenate(x) for x in (homes, ids, counts, several, grams))
        order = np.lexsort((id, gram))
        home, id, count, more, gram = home[order], id[order], count[order], more[order], gram[order]
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(gram)]]))
        twice = np.logical_or.reduceat(more, starts) | (id[starts + sizes - 1] > id[starts])
        hot = np.add.reduceat(count, starts) > most
        keep = np.repeat(twice, sizes)
        home, gram, hot = home[keep], gram[keep], np.repeat(hot, sizes)[keep]
        by = np.lexsort((gram, home))
        keys, blobs = [], []
        for a, b in _text.runs(home[by]):
            mine = by[a:b]
            keys.append(int(home[mine[0]]))
            blobs.append(_pack(_REPEAT_TYPES, np.diff(gram[mine], prepend=np.uint64(0)), hot[mine]))
        return pa.table([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["dest", "blob"])

    return run


def _send(strings: Callable, n: int, k: int, n_buckets: int):
    """The strings around the repeated minimisers of one group of documents, to the minimisers' buckets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, blobs = [], []
        if left.num_rows and right.num_rows:
            held = _Batch(n_buckets, left["dest"][0].as_py())
            table = _opened(left)
            docs = _docs_of(table)
            parts = [_packed.unpack(blob, *_REPEAT_TYPES) for blob in right["blob"].to_pylist()]
            gram, hot = np.concatenate([np.cumsum(g, dtype=np.uint64) for g, _ in parts]), np.concatenate([h for _, h in parts]).astype(bool)
            known, hot = np.unique(gram), np.unique(gram[hot])

            def flush() -> None:
                held.close_rows(docs)
                for key, blob in held.rows():
                    keys.append(key)
                    blobs.append(blob)

            data, offsets = _text.flat(table["text"])
            for found in strings(data, offsets, n, k, hot):
                mine = _among(found[6], known)
                held.add(data, tuple(x[mine] for x in found))
                if held.size >= FLUSH:
                    flush()
            flush()
        return pa.table([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _judge(covered: Callable, n_groups: int):
    """``covered(ids, pos, units, length, anchor, body)`` gives string, first and last + 1 unit (in the document) of spans."""

    def run(table: pa.Table) -> pa.Table:
        tables, cols, known = [], [[] for _ in range(6)], []
        n_docs = 0
        for blob in table["blob"].to_pylist():
            ids, keys, doc, pos, units, length, anchor, body, k_doc, k_from, k_to = _packed.unpack(blob, *_STRING_TYPES)
            t = np.empty(len(ids), _DOC)
            t["id"], t["key"] = ids, keys
            tables.append(t)
            known.append((k_doc.astype(np.int64) + n_docs, k_from.astype(np.int64), k_to.astype(np.int64)))
            for c, x in zip(cols, (doc.astype(np.int64) + n_docs, pos.astype(np.int64), units.astype(np.int64), length.astype(np.int64), anchor.astype(np.int64), body), strict=True):
                c.append(x)
            n_docs += len(ids)
        docs = np.concatenate(tables)
        doc, pos, units, length, anchor, body = (np.concatenate(c) for c in cols)
        which, a, b = covered(docs["id"][doc], pos, units, length, anchor, body)
        d, f, t = (np.concatenate(x) for x in zip(*known, (doc[which], a, b), strict=True))
        dest = np.mod(docs["key"][d], n_groups)
        order = np.lexsort((f, d, dest))
        d, f, t, dest = d[order], f[order], t[order], dest[order]
        keys, blobs = [], []
        for x, y in _text.runs(dest):
            used, local = np.unique(d[x:y], return_inverse=True)
            keys.append(int(dest[x]))
            blobs.append(_pack(_SPAN_TYPES, docs["id"][used], docs["key"][used], local, f[x:y], t[x:y]))
        return pa.table([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["dest", "blob"])

    return run


def _equal_bytes(body: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b are the same, for each pair of ranges of one length (not empty)."""
    out = np.empty(len(length), bool)
    for first, last in _text.blocks(length):
        size = length[first:last]
        same = body[_text.ragged(a[first:last], size)] == body[_text.ragged(b[first:last], size)]
        out[first:last] = np.logical_and.reduceat(same, np.cumsum(size) - size)
    return out


def _settled(ids: np.ndarray, string: np.ndarray, length: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Of strings in a row: whether each equals one of a smaller document. Strings with equal hashes are compared."""
    begin = np.cumsum(length) - length
    order = np.lexsort((ids, length, string))
    head = np.ones(len(order), bool)
    head[1:] = (string[order][1:] != string[order][:-1]) | (length[order][1:] != length[order][:-1])
    first = order[head][np.cumsum(head) - 1] if len(order) else order
    larger = np.flatnonzero(ids[order] > ids[first])
    out = np.zeros(len(order), bool)
    # a string that has its first one's hash and not its bytes is left to be judged window by window
    out[order[larger]] = _equal_bytes(body, begin[order[larger]], begin[first[larger]], length[order[larger]])
    return out


def settle_equal(ids: np.ndarray, length: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal strings: whether each is of a larger document than the smallest; and one string of each kind."""
    end = np.cumsum(length)
    string = np.empty(len(length), np.uint64)
    for first, last in _text.blocks(length):
        lo, hi = end[first] - length[first], end[last - 1]
        string[first:last] = _text.Rolling(body[lo:hi]).ranges(end[first:last] - length[first:last] - lo, end[first:last] - lo)
    larger = _settled(ids, string, length, body)
    # strings of the smallest document stay, even where it holds one twice
    return larger, np.flatnonzero(~larger)


def spans_of(string: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (string, first unit) as spans: runs of consecutive windows joined; sorted by string and unit."""
    if not len(string):
        z = np.empty(0, np.int64)
        return z, z, z
    new = np.flatnonzero((np.diff(string) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new - 1, [len(string) - 1]])
    return string[first], at[first], at[last] + n


def _spans_of_rows(keys: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last + 1 unit of all spans of documents with these keys, by row."""
    order = np.argsort(keys, kind="stable")
    rank = keys[order]
    rows, starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
    for blob in blobs:
        _, want, local, start, end = _packed.unpack(blob, *_SPAN_TYPES)
        lo, hi = np.searchsorted(rank, want, "left"), np.searchsorted(rank, want, "right")
        d = local.astype(np.int64)
        for extra in range(int((hi - lo).max(initial=0))):  # repeated rows of one document
            has = (lo + extra < hi)[d]
            rows.append(order[np.minimum(lo + extra, len(order) - 1)][d[has]])
            starts.append(start[has])
            ends.append(end[has])
    row, start, end = (np.concatenate(x) for x in (rows, starts, ends))
    by = np.argsort(row, kind="stable")
    return row[by], start[by], end[by]


def _covered_units(row: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which units spans cover, for documents with so many units, all in a row."""
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(int(sizes.sum()) + 1, np.int32)
    np.add.at(mark, begin[row] + start, 1)
    np.add.at(mark, begin[row] + end, -1)
    return np.cumsum(mark[:-1], out=mark[:-1]) > 0


def keep_bytes(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Kept bytes, units, removed units and removed runs of each document."""
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    at = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[at] = gone[at]

    def total(m: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(m) + 1, np.int32 if len(m) < 1 << 31 else np.int64)
        np.cumsum(m, out=sums[1:])
        return np.diff(sums[offsets].astype(np.int64))

    removed = total(gone)
    kept = data[~gone].tobytes()
    cut = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
    return [kept[a:b] for a, b in zip(cut, cut[1:], strict=False)], np.diff(offsets), removed, total(first)


def keep_words(data: np.ndarray, offsets: np.ndarray, words: tuple[np.ndarray, ...], gone: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """As keep_bytes, for words; kept words are joined by one space."""
    s, e, row = words
    n = len(offsets) - 1
    kept = ~gone
    length = (e - s)[kept]
    out = np.full(int(length.sum()) + len(length), 32, np.uint8)
    to = np.cumsum(length + 1) - length - 1
    out[_text.ragged(to, length)] = data[_text.ragged(s[kept], length)]
    raw = out.tobytes()
    cut = np.concatenate([[0], np.cumsum(np.bincount(row[kept], length + 1, n).astype(np.int64))])
    first = gone.copy()
    first[1:] &= ~(gone[:-1] & (row[1:] == row[:-1]))
    return [raw[a : max(a, b - 1)] for a, b in zip(cut, cut[1:], strict=False)], np.bincount(row, minlength=n), np.bincount(row[gone], minlength=n), np.bincount(row[first], minlength=n)


def _finish(names: list[str], by_words: bool, with_text: bool):
    """The documents of a group without their spans, and what is said of each."""

    def finished(left: pa.Table, spans: tuple[np.ndarray, ...]) -> pa.Table:
        data, offsets = _text.flat(left["text"])
        if by_words:
            found = _text.words(data, offsets)
            gone = _covered_units(*spans, np.bincount(found[2], minlength=left.num_rows))
            kept, units, removed, runs = keep_words(data, offsets, found, gone)
        else:
            gone = _covered_units(*spans, np.diff(offsets))
            kept, units, removed, runs = keep_bytes(data, offsets, gone)
        cols = [left["row"]]
        if with_text:
            # rows of which nothing is removed keep their text, a null one too
            old = left["text"].to_pylist()
            cols.append(pa.array([o if not r else x.decode("utf-8", "ignore") for o, r, x in zip(old, removed.tolist(), kept, strict=True)], pa.string()))
        digests = [hashlib.sha256(x).hexdigest() for x in kept]
        return pa.table([*cols, pa.array(units, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], names=names)

    def finish(group: pa.Table, right: pa.Table) -> pa.Table:
        left = _opened(group)
        row, start, end = _spans_of_rows(left["key"].to_numpy(), right["blob"].to_pylist())
        parts = []
        # a unit's marks take several times its bytes, so only some documents are marked at a time
        for a, b in _text.blocks(pc.fill_null(pc.binary_length(left["text"]), 0).to_numpy().astype(np.int64), FINISHED):
            x, y = np.searchsorted(row, [a, b])
            parts.append(finished(left.slice(a, b - a), (row[x:y] - a, start[x:y], end[x:y])))
        return pa.concat_tables(parts)

    return finish


def remove_repeats(docs: DataFrame, id: str, text: str, n: int, k: int, covered: Callable, by_words: bool, with_text: bool) -> DataFrame:
    """``docs`` with n_units, n_removed, n_spans and kept_sha256; and its text replaced by what is kept, if ``with_text``."""
    added = ["n_units", "n_removed", "n_spans", "kept_sha256"]
    body, (number, _) = _shared.column(text).cast("string"), _shared.null_last(docs, id)
    size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    n_anchors, n_buckets, n_groups = (max(FEWEST, -(-size // each)) for each in (ANCHOR_BUCKET, BUCKET, GROUP))
    key = F.xxhash64(number, body)
    strings = word_strings if by_words else byte_strings
    kept_columns = [c for c in _shared.others(docs, added) if c != text]
    whole = docs.select(F.pmod(key, F.lit(n_groups)).cast("int").alias("dest"), number.alias("id"), key.alias("key"), body.alias("text"), _shared.packed(kept_columns).alias("row"))
    rows = whole.schema["row"]
    whole = whole.mapInArrow(_dealt, "dest int, blob binary")
    # all uses of the texts by group share one exchange
    anchors = whole.groupBy("dest").applyInArrow(_anchors(strings, n, k, n_anchors), "bucket int, blob binary")
    repeated = anchors.groupBy("bucket").applyInArrow(_repeated(HOT), "dest int, blob binary")
    sent = whole.groupBy("dest").cogroup(repeated.groupBy("dest")).applyInArrow(_send(strings, n, k, n_buckets), "bucket int, blob binary")
    spans = sent.groupBy("bucket").applyInArrow(_judge(covered, n_groups), "dest int, blob binary")
    shape = [rows] + ([T.StructField("text", T.StringType())] if with_text else [])
    schema = T.StructType([*shape, *(T.StructField(c, T.LongType()) for c in added[:3]), T.StructField(added[3], T.StringType())])

    done = whole.groupBy("dest").cogroup(spans.groupBy("dest")).applyInArrow(_finish(schema.names, by_words, with_text), schema)
    return done.select(*_shared.unpacked(kept_columns), *([F.col("text").alias(text)] if with_text else []), *added)
