"""Ranked lexical search: every document is scored for every item, and documents of equal bags are scored once.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. Documents are
restricted to the vocabulary of the items: a bag is the term frequencies of the item terms that a document holds, beside its
number of terms. Bags with equal frequencies and equal length norm ``m`` form a class: they are grouped by a hash of
both and by both themselves, so that a hash alone decides nothing. Classes are scored, in blocks, against the posting lists
of all items; a class's members are put in by ascending id afterwards. No item needs more than the first ``k`` members
of its ``k`` best classes, best by score and then by smallest member, so only those are looked up.

With N documents that have terms, L terms of all documents, n terms of a document, df documents with a term and tf of its
occurrences in one: a term weighs ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, ``m = 25 + (75 n N) div L``, and a
document's score sums ``w * ((10**9 tf) div (1000 tf + 8 m))`` over an item's terms, repeats included, in 64-bit integers.

The items are the stated query set: they are sent to all tasks in blocks of about MAX_TERMS words and MAX_ITEMS items,
one item at least, and the texts are read once for each block.

Null and empty texts have no terms: such documents are never found and such items find nothing. Documents without an id
come behind others of equal score. Repeated rows of documents are documents of their own; repeated rows of items each
get their result. Empty tables give an empty table. Other columns of either table are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import _shared, _text
from docloom.llm.decontaminate import words_of

#: An item block has about so many words, and so many items; a longer item is a block of its own.
MAX_TERMS = 200_000
MAX_ITEMS = 20_000
#: So many scores are held at once by a task.
CELLS = 1 << 21

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KEYS = ["h", "m", "terms", "freqs"]


class _Vocabulary:
    """Terms by a hash of their bytes; what is looked up is compared byte by byte."""

    def __init__(self, terms: list[str]):
        data, offsets = _text.flat(pa.array(terms, pa.string()))
        for self.which in (0, 1):
            hashes = _text.Rolling(data, self.which).ranges(offsets[:-1], offsets[1:])
            order = np.argsort(hashes)
            if len(np.unique(hashes)) == len(terms):
                break
        else:
            raise ValueError("two terms of the items have one hash")
        self.data, self.start, self.size = data, offsets[:-1][order], np.diff(offsets)[order]
        self.hashes, self.term = hashes[order], order.astype(np.int32)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these words are terms, and their numbers."""
        h = _text.Rolling(data, self.which).ranges(start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        near = np.flatnonzero((self.hashes[at] == h) & (self.size[at] == end - start))
        at, size = at[near], (end - start)[near]
        same = data[_text.ragged(start[near], size)] == self.data[_text.ragged(self.start[at], size)]
        good = np.add.reduceat(~same, np.cumsum(size) - size) == 0 if len(near) else np.empty(0, bool)
        return near[good], self.term[at[good]]


def _bags(terms):
    """Batches of id and text -> id, n, terms, freqs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(terms.value)
        for batch in batches:
            data, offsets = _text.flat(batch.column("text"))
            for a, b in _text.blocks(np.diff(offsets)):
                low = _text.LOWER[data[offsets[a] : offsets[b]]]
                start, end, row = _text.words(low, offsets[a : b + 1] - offsets[a], _IS_TERM)
                which, term = vocabulary.find(low, start, end)
                key, freq = np.unique(row[which] * len(vocabulary.hashes) + term, return_counts=True)
                held = np.concatenate([[0], np.cumsum(np.bincount(key // len(vocabulary.hashes), minlength=b - a))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(held), pa.array(x.astype(np.int32))) for x in (key % len(vocabulary.hashes), freq)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(np.bincount(row, minlength=b - a).astype(np.int64)), *lists], ["id", "n", "terms", "freqs"])

    return run


def _best_classes(query, k: int):
    """Batches of classes -> q, score and the class: each item's k best of the task, by score and then by smallest member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, first, items, times, n_items = query.value
        best: list[list[tuple]] = [[] for _ in range(n_items)]
        least = np.ones(n_items, np.int64)
        step = max(1, CELLS // n_items)
        schema = None
        for whole in batches:
            schema = whole.schema
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                rows = batch.num_rows
                sizes = np.asarray(batch.column("terms").value_lengths())
                term, tf = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("terms", "freqs"))
                m = np.repeat(np.asarray(batch.column("m")), sizes)
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                cls = np.repeat(np.arange(rows), sizes)
                score = np.zeros(rows * n_items, np.int64)
                posted = first[term + 1] - first[term]
                ends = np.cumsum(posted)
                at = 0
                while at < len(term):  # postings in stretches of bounded length
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
                    p = _text.ragged(first[term[at:to]], posted[at:to])
                    np.add.at(score, np.repeat(cls[at:to], posted[at:to]) * n_items + items[p], np.repeat(value[at:to], posted[at:to]) * times[p])
                    at = to
                score = score.reshape(rows, n_items)
                bound = np.maximum(least, np.partition(score, rows - k, axis=0)[rows - k]) if rows > k else least
                r, q = np.nonzero(score >= bound)
                if not len(r):
                    continue
                order = np.argsort(q, kind="stable")
                r, q = r[order], q[order]
                for lo, hi in _text.runs(q):
                    j = int(q[lo])
                    near = batch.take(pa.array(r[lo:hi])).to_pylist()
                    best[j] += [(-int(s), x["id"] is None, x["id"], x["h"], x) for s, x in zip(score[r[lo:hi], j], near, strict=True)]
                    # of two without an id either may stand for its equals
                    best[j].sort(key=lambda y: y[:2] + ((y[3],) if y[1] else (y[2], y[3])))
                    del best[j][k:]
                    if len(best[j]) == k:
                        least[j] = max(1, -best[j][-1][0])
        found = [(j, -y[0], y[4]) for j, list_ in enumerate(best) for y in list_]
        if found:
            cols = [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64())]
            cols += [pa.array([x[2][c] for x in found], schema.field(c).type) for c in ("id", *_KEYS)]
            yield pa.RecordBatch.from_arrays(cols, ["q", "score", "id", *_KEYS])

    return run


def _item_blocks(items: DataFrame) -> Iterator[list]:
    """Rows of item_id, words and copies, in blocks of bounded size."""
    total, count = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.count("*")).first()
    if not count:
        return
    n = max(1, -(-total // MAX_TERMS), -(-count // MAX_ITEMS))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(n)))
        sizes = dealt.groupBy("block").agg(F.sum(F.size("words")).alias("w"), F.count("*").alias("c"))
        if n == 1 or sizes.where((F.col("c") > 1) & ((F.col("w") > 2 * MAX_TERMS) | (F.col("c") > 2 * MAX_ITEMS))).isEmpty():
            break
        n *= 2
    for b in range(n):
        if rows := dealt.where(F.col("block") == b).drop("block").collect():
            yield rows


def _ranked(docs: DataFrame, block: list, item_type: T.DataType, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for the items of one block."""
    spark = docs.sparkSession
    terms = sorted({w for r in block for w in r["words"]})
    number = {w: i for i, w in enumerate(terms)}
    posts = np.array([(number[w], q) for q, r in enumerate(block) for w in r["words"]], np.int64).reshape(-1, 2)
    pairs, times = np.unique(posts, axis=0, return_counts=True)
    id_type = docs.schema["id"].dataType
    bag_schema = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("freqs", T.ArrayType(T.IntegerType()))])
    bags = _shared.written(docs.mapInArrow(_bags(spark.sparkContext.broadcast(terms)), bag_schema), "bags")
    n_docs, n_terms = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_terms:
        return None
    m = F.expr(f"25L + (75L * n * {n_docs}L) div {n_terms}L")
    held = bags.where(F.size("terms") > 0).withColumn("m", m).withColumn("h", F.xxhash64("m", "terms", "freqs"))
    classes = _shared.written(held.groupBy(*_KEYS).agg(F.count("*").alias("members"), F.min("id").alias("id")), "classes")
    df = np.zeros(len(terms), np.int64)
    for t, c in classes.select(F.explode("terms").alias("t"), "members").groupBy("t").agg(F.sum("members")).collect():
        df[t] = c
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    query = spark.sparkContext.broadcast((weight, first, pairs[:, 1].copy(), times, len(block)))
    shape = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("id", id_type), *(classes.schema[c] for c in _KEYS)])
    best = classes.select("id", *_KEYS).mapInArrow(_best_classes(query, k), shape)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "h")
    best = _shared.written(best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r", "id"), "best")
    # members of these classes only: at most k hashes an item are sent, and k members of a class leave a task
    near = held.select("id", *_KEYS).join(F.broadcast(best.select("h").distinct()), "h", "left_semi")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy(*_KEYS).orderBy(F.asc_nulls_last("id")))).where(F.col("r") <= k).drop("r")
    found = best.join(near, _KEYS).select("q", "score", "id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, r["item_id"], r["copies"]) for q, r in enumerate(block)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", item_type), T.StructField("copies", T.LongType())]))
    out = found.join(F.broadcast(names), "q").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` best documents with a score above 0, or all if fewer."""
    asked = items.select(_shared.column(item_id).alias("item_id"), words_of(_shared.column(item_text).cast("string")).alias("words"))
    asked = asked.where(F.size("words") > 0).groupBy("item_id", "words").agg(F.count("*").alias("copies"))
    rows = docs.select(_shared.column(id).alias("id"), _shared.column(text).cast("string").alias("text"))
    out = None
    for block in _item_blocks(asked):
        ranked = _ranked(rows, block, asked.schema["item_id"].dataType, k)
        if ranked is not None:
            out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        empty = T.StructType([asked.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", rows.schema["id"].dataType), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], empty)
    return out
