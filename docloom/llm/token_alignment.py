"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of the corpus.

Documents are shuffled by their full texts, so each distinct text is tokenised and aligned once. Vocabulary A is a
byte-level BPE and reads a space and the text; vocabulary B is a BPE over pieces and adds that space itself. Byte offsets at
which a token of both ends cut the tokens into groups; a link is a pair of occurrences whose byte ranges overlap. A
pair of ids counts how many links hold it in the corpus: the links of a distinct text count once for every document that
has the text. Measures of texts are joined back to the documents by the texts' SHA-256.

Neither vocabulary has a token that goes on behind a character that is no white space with a space (B is asked for such pieces when
it is read, A cuts there itself), so tokens never cross from one such stretch to the next. A worker therefore keeps what it has
found out about the stretches it has seen, up to MAX_KEPT bytes, and a text is put together from its stretches. Where a
stretch does not come back as its own bytes, the whole text is tokenised in one go and compared.

Texts that are null, empty, or come back from either vocabulary as other bytes have no tokens: all their numbers are 0 and
``groups`` and ``groups_sha256`` are empty. Special tokens' strings inside a text are plain text. Ids are not read and may be
null or repeat. Empty tables give empty tables. Columns of any names are kept, except those called as what is added.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import _shared, _text

FILE_A, FILE_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Counts of so many pairs are broadcast; more are joined by pair.
MAX_PAIRS = 500_000
#: A worker keeps the ids of stretches up to so many bytes; those beyond are tokenised in each block anew.
MAX_KEPT = 96 << 20
_BLOCK = 1 << 21
_COMMA, _BAR, _SEMICOLON = b",|;"

#: A space behind white space: such a text is cut by _CUT instead of at every space.
_LONG_GAP = re.compile(r"\s ")
#: Strings on which all readers of A's pattern agree: no characters of newer versions of Unicode, no white space but these.
_COMMON = re.compile("[\t\n -~\u00a1-\u017f]*")
# Fixed value: how a byte-level vocabulary cuts texts.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_CUT = re.compile(r"(?<=\S)(?= )")


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Aligned:
    """A block of texts: rows of n_a, n_b, n_groups, n_links; groups; distinct pairs (a * B's size + b) and the links of each, by text."""

    counts: np.ndarray
    groups: list[bytes]
    held: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


class _Known:
    """Token ids of stretches by their numbers."""

    def __init__(self):
        self.good, self.sizes, self.ids, self.first = np.empty(0, bool), np.empty((2, 0), np.int64), [np.empty(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2

    def with_more(self, good: np.ndarray, ids: list[list[list[int]]]) -> _Known:
        out = _Known()
        sizes = np.array([[len(x) for x in side] for side in ids], np.int64)
        out.good, out.sizes = np.concatenate([self.good, good]), np.concatenate([self.sizes, sizes], axis=1)
        out.ids = [np.concatenate([old, np.fromiter(chain.from_iterable(side), np.int32, n)]) for old, side, n in zip(self.ids, ids, sizes.sum(1), strict=True)]
        out.first = [np.concatenate([[0], np.cumsum(x)]) for x in out.sizes]
        return out

    def tokens(self, side: int, at: np.ndarray) -> np.ndarray:
        return self.ids[side][_text.ragged(self.first[side][at], self.sizes[side][at])]


class Aligner:
    """Both vocabularies, from the contents of their files."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_buffer(a)
        self.first.encode_special_tokens = True
        self.second = sp = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = _byte_level()
        decoded = {i: bytes(letters[c] for c in s) for s, i in self.first.get_vocab().items() if all(c in letters for c in s)}
        self.bytes_a = [decoded.get(i, b"") for i in range(self.first.get_vocab_size())]
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.encode().replace("▁".encode(), b" ") for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        self.size_b = len(pieces)
        self.in_stretches = not any(re.search("[^▁]▁", p) for p in pieces)
        self.quick = None
        merges = [m if isinstance(m, list) else m.split(" ") for m in json.loads(a)["model"]["merges"]]
        vocabulary = self.first.get_vocab()
        if [vocabulary.get("".join(m)) for m in merges] == list(range(256, 256 + len(merges))):
            # ids in the order of the merges: the same vocabulary as ranks
            self.quick = tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks={decoded[i]: i for i in range(256 + len(merges))}, special_tokens={})
        self.number: dict[str, int] = {}
        self.known, self.kept = _Known(), 0

    def encode(self, strings: list[str]) -> list[list[list[int]]]:
        """Token ids of A and of B for strings that begin with a space."""
        ids: list = [None] * len(strings)
        rest = []
        for i, s in enumerate(strings):
            if self.quick and _COMMON.fullmatch(s):
                ids[i] = self.quick.encode_ordinary(s)
            else:
                rest.append(i)
        for i, x in zip(rest, self.first.encode_batch([strings[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = x.ids
        return [ids, self.second.encode([s[1:] for s in strings], num_threads=1)]

    def _learn(self, strings: list[str], known: _Known) -> _Known:
        """What is known, and these strings behind it; a string is good if both sides come back as its bytes."""
        ids = self.encode(strings)
        raw = [s.encode() for s in strings]
        back = [[b"".join(map(names.__getitem__, x)) for x in side] for names, side in zip((self.bytes_a, self.bytes_b), ids, strict=True)]
        good = np.fromiter((r == x == y for r, x, y in zip(raw, *back, strict=True)), bool, len(raw))
        return known.with_more(good, [[x if g else [] for x, g in zip(side, good.tolist(), strict=True)] for side in ids])

    def _stretches(self, whole: str) -> list[str]:
        if not self.in_stretches:
            return [whole]
        if _LONG_GAP.search(whole) or whole[-1] == " ":
            cut = _CUT.split(whole)
            return cut if len(cut) < 2 or cut[-1].strip(" ") else [*cut[:-2], cut[-2] + cut[-1]]
        return whole[1:].split(" ")

    def _numbered(self, wholes: list[str]) -> tuple[_Known, np.ndarray, np.ndarray]:
        """What is known, the numbers of all stretches in a row, and the text of each; only texts that come back as they were."""
        # the space in front of a stretch is left out of the look-up where it is one space
        cut = [self._stretches(w) if w else [] for w in wholes]
        row = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        flat = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        missed = np.flatnonzero(at < 0)
        new: dict[str, int] = {}
        for i in missed.tolist():
            at[i] = new.setdefault(flat[i], len(self.number) + len(new))
        known = self._learn([s if s[:1] == " " else " " + s for s in new], self.known) if new else self.known
        if new and self.kept < MAX_KEPT:
            self.number.update(new)
            self.known, self.kept = known, self.kept + sum(map(len, new)) + 200 * len(new)
        odd = np.unique(row[~known.good[at]])
        if len(odd):
            again = np.full(len(wholes), -1)
            long = [i for i in odd.tolist() if len(cut[i]) > 1]
            if long:
                again[long] = np.arange(len(long)) + len(known.good)
                known = self._learn([wholes[i] for i in long], known)
            again[[i for i in long if not known.good[again[i]]]] = -1
            stay = ~np.isin(row, odd)
            retried = np.flatnonzero(again >= 0)
            row, at = np.concatenate([row[stay], retried]), np.concatenate([at[stay], again[retried]])
            order = np.argsort(row, kind="stable")
            row, at = row[order], at[order]
        return known, at, row

    def measure(self, texts: list[str | None]) -> Aligned:
        """Aligns a block of texts."""
        n = len(texts)
        known, at, row = self._numbered([" " + t if t else "" for t in texts])
        a, b = known.tokens(0, at), known.tokens(1, at)
        n_a, n_b = (np.bincount(row, known.sizes[side][at], n).astype(np.int64) for side in (0, 1))
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        over = np.searchsorted(end_b, end_a)  # the token of B that covers the last byte of each of A
        common = end_b[over] == end_a if len(over) else np.empty(0, bool)
        row_a = np.repeat(np.arange(n), n_a)
        lo = np.concatenate([[0], (over + common)[:-1]]) if len(over) else over
        links = over + 1 - lo
        key = np.repeat(row_a * (len(self.bytes_a) * self.size_b) + a.astype(np.int64) * self.size_b, links) + b[_text.ragged(lo, links)]
        key, times = np.unique(key, return_counts=True)
        per_text = len(self.bytes_a) * self.size_b
        counts = np.stack([n_a, n_b, np.bincount(row_a[common], minlength=n), np.bincount(row_a, links, n).astype(np.int64)], axis=1)
        return Aligned(counts, self._listed(a, b, n_a, n_b, common, over), np.bincount(key // per_text, minlength=n), key % per_text, times)

    def _listed(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, common: np.ndarray, over: np.ndarray) -> list[bytes]:
        """The groups of each text, from the tokens of all texts in a row."""
        last_a, last_b = common, np.zeros(len(b), bool)
        last_b[over[common]] = True
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ids, mark = np.empty(len(a) + len(b), np.int32), np.empty(len(a) + len(b), np.uint8)
        to = np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]
        ids[to], mark[to] = a, np.where(last_a, _BAR, _COMMA)
        to = np.arange(len(b)) + upto_a[group_b]
        ids[to], mark[to] = b, np.where(last_b, _SEMICOLON, _COMMA)
        size = 2 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 9))
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] = mark
        left, at = ids, ends - 2
        while len(left):
            out[at] = 48 + left % 10
            more = left >= 10
            left, at = left[more] // 10, at[more] - 1
        # a text's last separator is left out
        stop = np.concatenate([[0], ends])[np.cumsum(n_a + n_b)].tolist()
        raw, begin = out.tobytes(), 0
        lines = []
        for end in stop:
            lines.append(raw[begin : max(begin, end - 1)])
            begin = end
        return lines


@lru_cache(maxsize=1)
def _aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


#: What a text has of its own; ``pairs`` are its distinct pairs of ids, and ``times`` the links of each.
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
_SHAPE = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<bigint>, times array<int>"


def _measured(files, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        for batch in batches:
            lengths = np.diff(_text.flat(batch.column("text"))[1])
            for first, last in _text.blocks(lengths, _BLOCK):
                part = batch.slice(first, last - first)
                done = aligner.measure(part.column("text").to_pylist())
                cols = [part.column("key"), part.column("copies"), *[pa.array(c) for c in done.counts.T]]
                cols.append(pa.array([g.decode() for g in done.groups] if with_groups else [None] * len(done.groups), pa.string()))
                cols.append(pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in done.groups], pa.string()))
                held = pa.array(np.concatenate([[0], np.cumsum(done.held)]).astype(np.int32))
                cols += [pa.ListArray.from_arrays(held, pa.array(x)) for x in (done.pairs, done.times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [x.split(" ")[0] for x in _SHAPE.split(", ")]
    return run


def align_texts(docs: DataFrame, text: str = "text", file_a: str = FILE_A, file_b: str = FILE_B, with_groups: bool = False) -> DataFrame:
    """A row for each distinct text, written to the shared folder: its SHA-256 as ``key``, copies, measures, groups, pairs, times."""
    body = _shared.column(text).cast("string")
    distinct = docs.select(body.alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    files = docs.sparkSession.sparkContext.broadcast((Path(file_a).read_bytes(), Path(file_b).read_bytes()))
    keyed = distinct.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")
    return _shared.written(keyed.mapInArrow(_measured(files, with_groups), _SHAPE), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, links: how many links of the corpus hold each pair of ids."""
    held = aligned.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("copies") * F.col("x.times")).alias("links"))


def align_documents(docs: DataFrame, text: str = "text", file_a: str = FILE_A, file_b: str = FILE_B, with_groups: bool = False) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if ``with_groups``."""
    added = [*MEASURES, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    spark = docs.sparkSession
    size_b = _aligner(Path(file_a).read_bytes(), Path(file_b).read_bytes()).size_b
    aligned = align_texts(docs, text, file_a, file_b, with_groups)
    counts = pair_counts(aligned).withColumn("b", F.col("pair") % size_b)
    counts = _shared.written(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    ranked = counts.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    if counts.count() <= MAX_PAIRS:
        ranked = F.broadcast(ranked)
    held = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    scored = held.join(ranked, "pair").groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    texts = aligned.select("key", *MEASURES, "groups_sha256", *(["groups"] if with_groups else [])).join(scored, "key", "left")
    keep = _shared.others(docs, added)
    rows = docs.select(_shared.packed(keep).alias("row"), F.unhex(F.sha2(_shared.column(text).cast("string"), 256)).alias("key"))
    out = rows.join(texts, "key", "left")
    kinds = {c: F.lit("") if c.startswith("groups") else F.lit(0).cast("long") for c in added}
    return out.select(*_shared.unpacked(keep), *[F.coalesce(F.col(c), kinds[c]).alias(c) for c in added])
