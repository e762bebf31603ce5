"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts (up to three bytes) with counts of the bytes
that followed. A byte's probability is taken from the longest context known in that language; a byte
that has not followed it costs an escape (method C: distinct followers over followers plus distinct
ones) and is looked up in the next shorter context, down to 1/256. The statistics are frozen after
training; a text's code length is the sum over its bytes. The language with the shortest code is predicted.
The score is its posterior probability under equal priors after SCORE_BYTES bytes (fewer, if the text is
shorter) that cost as much as the text's bytes do on average, so long texts of mixed languages do not score 1.

Every language of a labelled row that is not held out and has a text can be predicted, and no context is
dropped. Learning uses whole texts from a sample of about ``sample_bytes`` bytes of each language, one text
at least. The trees are kept sparse, as sorted tables of what was seen; they are broadcast in blocks of
languages with at most MAX_ENTRIES entries together, as no language's code length depends on another.

Null texts and those without letters are ``und`` with score 0, and so is everything where nothing could be
learned. Ties go to the first language by code point. Repeated rows are predicted alike. A null id is
neither held out nor learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import _shared, _text

#: Letters in lower case, digits as 0, white space and controls as a space.
_FOLD = _text.LOWER.copy()
_FOLD[48:58] = 48
_FOLD[:33] = 32
_BLOCK = 1 << 19
#: So many entries of trees (some 14 bytes each) are broadcast together.
MAX_ENTRIES = 8_000_000
#: So many code lengths are held at once.
CELLS = 1 << 20
#: The score is that of a text of so many bytes.
SCORE_BYTES = 16
#: So many languages are sent to every task; more are joined by key.
MAX_BROADCAST_LANGUAGES = 100_000


def held_out(id: Column) -> Column:
    """Rows that are never learned from: the CRC-32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _padded(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each behind ``order`` spaces, and where they begin."""
    data, offsets = _text.flat(texts)
    n = len(offsets) - 1
    out = np.full(len(data) + order * n, 32, np.uint8)
    begin = offsets[:-1] + order * np.arange(1, n + 1)
    out[_text.ragged(begin, np.diff(offsets))] = _FOLD[data]
    return out, np.concatenate([begin, [len(out) + order]])


def _count(order: int):
    """(language, context length, context and byte in one number, count) of the n-grams of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = _padded(batch.column("text"), order)
            lang = np.repeat(batch.column("l").to_numpy(), np.diff(begin) - order).astype(np.uint64)
            at = _text.ragged(begin[:-1], np.diff(begin) - order)
            for k in range(order + 1):
                gram = np.zeros(len(at), np.uint64)
                for j in range(k, -1, -1):
                    gram = (gram << np.uint64(8)) | data[at - j].astype(np.uint64)
                key, n = np.unique((lang << np.uint64(40)) | gram, return_counts=True)
                yield pa.record_batch([pa.array((key >> np.uint64(40)).astype(np.int32)), pa.array(np.full(len(key), k, np.int32)), pa.array((key & np.uint64((1 << 40) - 1)).astype(np.int64)), pa.array(n.astype(np.int64))], ["l", "k", "gram", "n"])

    return run


@dataclass
class Sparse:
    """Bits by key and language: the entries of ``keys[i]`` are from ``first[i]`` to ``first[i + 1]``."""

    keys: np.ndarray
    first: np.ndarray
    language: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(key: np.ndarray, language: np.ndarray, bits: np.ndarray) -> Sparse:
        order = np.lexsort((language, key))
        keys, first = np.unique(key[order], return_index=True)
        return Sparse(keys, np.append(first, len(key)), language[order].astype(np.int32), bits[order].astype(np.float32))

    def entries(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of ``wanted``, language and bits of each entry."""
        if not len(self.keys):
            none = np.empty(0, np.int64)
            return none, none, none
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        rows = np.flatnonzero(self.keys[at] == wanted)
        start, n = self.first[at[rows]], np.diff(self.first)[at[rows]]
        entry = _text.ragged(start, n)
        return np.repeat(rows, n), self.language[entry], self.bits[entry]


@dataclass
class Block:
    """The trees of some languages: by context length, what each seen byte costs behind a context, and what leaving the context costs."""

    languages: list[str]
    seen: list[Sparse]
    escape: list[Sparse]

    @staticmethod
    def of(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Block:
        """``counts`` by context length: language, context and byte, count."""
        seen, escape = [], []
        for lang, gram, n in counts:
            _, first, context = np.unique(np.stack([gram >> 8, lang]), axis=1, return_index=True, return_inverse=True)
            context = context.ravel()
            distinct = np.bincount(context)
            all_ = np.bincount(context, n) + distinct
            seen.append(Sparse.of(gram, lang, np.log2(all_[context] / n)))
            escape.append(Sparse.of(gram[first] >> 8, lang[first], np.log2(all_ / distinct)))
        return Block(languages, seen, escape)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """What the last byte of each gram (a longest context and a byte) costs in each language."""
        out = np.full((len(grams), len(self.languages)), 8, np.float32)
        for k, (seen, escape) in enumerate(zip(self.seen, self.escape, strict=True)):
            row, lang, bits = escape.entries((grams >> 8) & ((1 << 8 * k) - 1))
            out[row, lang] += bits
            row, lang, bits = seen.entries(grams & ((1 << 8 * (k + 1)) - 1))
            out[row, lang] = bits
        return out


@dataclass
class Model:
    """Frozen statistics of all languages."""

    languages: list[str]
    blocks: list[Block]


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 3, sample_bytes: int = 1_000_000) -> Model:
    """A model of the labelled rows that are not held out; what is learned from is bounded by ``sample_bytes`` for each language."""
    c = _shared.column
    known = docs.select(c(id).alias("id"), c(text).cast("string").alias("text"), c(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("id")))
    known = known.withColumn("drawn", F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) / 1e6)
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("drawn").alias("least"))
    rows = sorted(sizes.collect(), key=lambda r: r["lang"])  # one small row per language
    languages = [r["lang"] for r in rows]
    if not languages:
        return Model([], [])
    shares = docs.sparkSession.createDataFrame([(r["lang"], i, max(sample_bytes / r["bytes"], 0.0), r["least"]) for i, r in enumerate(rows)], "lang string, l int, share double, least double")
    sample = known.join(F.broadcast(shares) if len(rows) <= MAX_BROADCAST_LANGUAGES else shares, "lang").where("drawn < share OR drawn = least").select("l", "text")
    counted = _shared.written(sample.mapInArrow(_count(order), "l int, k int, gram long, n long").groupBy("l", "k", "gram").agg(F.sum("n").alias("n")), "counts")
    entries = dict(counted.groupBy("l").count().collect())
    model, held = Model(languages, []), []
    for i in range(len(languages)):
        held.append(i)
        if i + 1 == len(languages) or sum(entries.get(x, 0) for x in [*held, i + 1]) > MAX_ENTRIES:
            got = counted.where(F.col("l").between(held[0], held[-1])).toArrow()
            k_all = got["k"].to_numpy()
            of = lambda name, k: got[name].to_numpy()[k_all == k]  # noqa: B023, E731
            model.blocks.append(Block.of(languages[held[0] : held[-1] + 1], [(of("l", k) - held[0], of("gram", k), of("n", k)) for k in range(order + 1)]))
            held = []
    return model


def block_code_lengths(block: Block, texts: pa.Array, order: int = 3) -> np.ndarray:
    """Bits of each text in each language of a block."""
    out = np.zeros((len(texts), len(block.languages)))
    lengths = np.diff(_text.flat(texts)[1])
    step = max(1, CELLS // len(block.languages))
    for first, last in _text.blocks(lengths, _BLOCK):
        data, begin = _padded(texts.slice(first, last - first), order)
        sizes = np.diff(begin) - order
        row = np.repeat(np.arange(first, last, dtype=np.int32), sizes)
        ending = np.zeros(len(data), np.uint32)  # what ends at each byte; contexts are at most three bytes
        for j in range(order + 1):
            ending[j:] |= data[: len(data) - j].astype(np.uint32) << np.uint32(8 * j)
        of_text = np.ones(len(data), bool)
        of_text[(begin[:-1, None] - np.arange(1, order + 1)).ravel()] = False
        grams = ending[of_text]
        del ending, data, of_text
        for a in range(0, len(grams), _BLOCK):  # a long text in pieces
            which, distinct = pd.factorize(grams[a : a + _BLOCK])
            distinct = distinct.astype(np.int64)
            for u in range(0, len(distinct), step):
                bits = block.bits(distinct[u : u + step])
                mine = np.flatnonzero((which >= u) & (which < u + step)) if len(distinct) > step else np.arange(len(which))
                for b in range(0, len(mine), step):
                    part = mine[b : b + step]
                    of = row[a + part]
                    runs = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                    out[of[runs]] += np.add.reduceat(bits[which[part] - u], runs, axis=0, dtype=np.float64)
    return out


def code_lengths(model: Model, texts: pa.Array, order: int = 3) -> np.ndarray:
    """Bits of each text in each language."""
    return np.concatenate([np.zeros((len(texts), 0)), *(block_code_lengths(b, texts, order) for b in model.blocks)], 1)


def _judge(sent):
    """The best language of a block and of those before it; its bits, and the sum of all languages' odds against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            n = batch.num_rows
            texts = batch.column("judged")
            valid = batch.column("letters").to_numpy(zero_copy_only=False)
            bits = block_code_lengths(block, texts)
            size = np.diff(_text.flat(texts)[1])
            scale = np.minimum(size, SCORE_BYTES) / np.maximum(size, 1)
            had, odds = batch.column("bits").to_numpy(zero_copy_only=False), batch.column("odds").to_numpy(zero_copy_only=False)
            best = bits.argmin(1) if n else np.empty(0, np.int64)
            least = np.minimum(had, bits.min(1)) if n else had
            against = lambda b: np.exp2(-np.minimum((b - least[:, None]) * scale[:, None], 1000)).sum(1)  # noqa: B023, E731
            odds = np.where(np.isinf(had), 0, odds * np.exp2(-np.minimum((np.where(np.isinf(had), least, had) - least) * scale, 1000))) + against(bits)
            old = batch.column("lang_pred").to_pylist()
            names = [None if not v else block.languages[b] if x < h else o for v, b, x, h, o in zip(valid.tolist(), best.tolist(), bits.min(1).tolist() if n else [], had.tolist(), old, strict=True)]
            new = {"lang_pred": pa.array(names, pa.string()), "bits": pa.array(least), "odds": pa.array(odds)}
            yield pa.record_batch([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return run


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte; columns of these names are replaced, columns of any other names are kept."""
    keep = _shared.others(docs, ["lang_pred", "score", "bits_per_byte"])
    t = _shared.column(text).cast("string")
    # the text travels once: as what is judged, and back as itself
    packed = [c for c in keep if c != text or docs.schema[text].dataType != T.StringType()]
    letters = F.coalesce(t.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(_shared.packed(packed).alias("row"), t.alias("judged"), letters.alias("letters"), F.lit(None).cast("string").alias("lang_pred"), F.lit(float("inf")).alias("bits"), F.lit(0.0).alias("odds"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    for block in model.blocks:
        rows = rows.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(block)), schema)
    known = F.col("lang_pred").isNotNull()
    score = F.when(known, 1 / F.col("odds")).otherwise(0.0)
    per_byte = F.when(known, F.col("bits") / F.greatest(F.octet_length("judged"), F.lit(1))).otherwise(0.0)
    own = dict(zip(packed, _shared.unpacked(packed), strict=True)) | ({} if text in packed else {text: F.col("judged").alias(text)})
    return rows.select(*[own[c] for c in keep], F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"), per_byte.alias("bits_per_byte"))
