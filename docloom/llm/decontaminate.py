"""Benchmark decontamination with DataFrame functions only.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. The
windows of ``n`` consecutive words of each benchmark item (an item of fewer words is one window) form
a hash set that is broadcast, keyed by a hash of the whole window; a window that many items share is in it
once. Every document is cut into words once, every position looks up one hash for each length that windows
have, and what is found is verified word by word. Items are named afterwards, from the windows a document
holds. A set of more than MAX_WINDOWS windows or MAX_CHARS characters is not broadcast: positions and windows
are then joined by their hash, and hits are verified by a second join with their documents.

Null texts and texts without words have no windows and no hits. Items without words are ignored. An item
without an id hits like others and counts as one item, but has no name to list. Repeated rows are judged
alike. Rows with a null id are judged like others, by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import _shared

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: So many windows, of so many characters together, may be broadcast.
MAX_WINDOWS = 200_000
MAX_CHARS = 32_000_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _GAP), ""), F.array().cast("array<string>"))


def _key(hashed: Column, length: Column) -> Column:
    """The hash of a window by the hashes of its words."""
    return F.xxhash64(length, hashed)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = 10) -> DataFrame:
    """item_id, win (its words), len, key: every distinct window of every item."""
    w = items.select(_shared.column(item_id).alias("item_id"), words_of(_shared.column(text).cast("string")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    w = w.select("item_id", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("win"))
    return w.withColumn("key", _key(_hashes(F.col("win")), F.col("len"))).distinct()


def _looked_up(docs: DataFrame, windows: DataFrame, id: str, text: str, every: bool) -> DataFrame:
    """id, text_hash, n_words, pos, len, key: a row for each hit, and one with pos -1 for each row of ``docs`` if ``every``."""
    t = _shared.column(text).cast("string")
    worded = docs.select(_shared.column(id).alias("id"), F.xxhash64(t).alias("text_hash"), words_of(t).alias("words"))
    base = worded.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("key"))
    distinct = windows.select("len", "win", "key").distinct()
    lengths, total, chars = distinct.agg(F.array_sort(F.collect_set("len")), F.count("*"), F.coalesce(F.sum(F.length(F.array_join("win", " "))), F.lit(0))).first()
    if not total:
        return base if every else base.limit(0)
    hashed = worded.select("*", _hashes(F.col("words")).alias("h"))
    first = F.lit(-1 if every else 0)
    at = hashed.where(F.size("words") > 0) if not every else hashed
    at = at.select("*", F.explode(F.sequence(first, F.size("words") - 1)).alias("pos"))
    if len(lengths) > 1:
        # a row that stands for its document looks nothing up, so one length will do
        at = at.select("*", F.explode(F.when(F.col("pos") < 0, F.array(F.lit(0))).otherwise(F.array(*[F.lit(n) for n in lengths]))).alias("len"))
    else:
        at = at.withColumn("len", F.when(F.col("pos") < 0, F.lit(0)).otherwise(F.lit(lengths[0])))
    fits = (F.col("pos") >= 0) & (F.col("pos") + F.col("len") <= F.size("words"))
    at = at.withColumn("key", F.when(fits, _key(F.slice("h", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("len")), F.col("len"))))
    found = ["id", "text_hash", F.size("words").cast("long").alias("n_words"), "pos", "len", "key"]
    same = F.slice("words", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("len")) == F.col("win")
    if total <= MAX_WINDOWS and chars <= MAX_CHARS:
        both = at.join(F.broadcast(distinct.withColumnRenamed("len", "win_len")), "key", "left")
        return both.where((F.col("pos") < 0) | F.coalesce(same, F.lit(False))).select(*found)
    near = at.where(fits).select(*found).join(distinct.drop("len"), "key")
    whole = worded.select(F.col("id").alias("id2"), F.col("text_hash").alias("hash2"), "words").distinct()
    hits = near.join(whole, F.col("id").eqNullSafe(F.col("id2")) & (F.col("text_hash").eqNullSafe(F.col("hash2")))).where(same).select("id", "text_hash", "n_words", "pos", "len", "key")
    return base.unionByName(hits) if every else hits


def judge(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", n: int = 10) -> DataFrame:
    """id, n_words, n_hit, n_items, items (sorted as strings), contaminated: one row per row of ``docs``."""
    windows = benchmark_windows(items, n=n)
    rows = _looked_up(docs, windows, id, text, True)
    hit = F.col("pos") >= 0
    by = rows.groupBy("id", "text_hash").agg(
        F.count_if(~hit).alias("rows"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("pos", "len"))).alias("spans"),
        F.collect_set("key").alias("keys"),
    )
    # one narrow row per document, used twice; only documents with hits have more than counts
    by = _shared.cut(by)
    named = by.where(F.size("keys") > 0).select(F.col("id").alias("id2"), F.col("text_hash").alias("hash2"), F.explode("keys").alias("key"))
    named = named.join(windows.select("key", "item_id"), "key").groupBy("id2", "hash2").agg(F.collect_set(F.struct(F.col("item_id").cast("string").alias("i"))).alias("items"))
    both = by.join(named, F.col("id").eqNullSafe(F.col("id2")) & (F.col("text_hash").eqNullSafe(F.col("hash2"))), "left")
    none = F.array().cast("array<string>")
    out = both.select(
        F.col("id").alias(id),
        "n_words",
        F.size(hit_positions(F.col("spans"))).cast("long").alias("n_hit"),
        F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_sort(F.filter(F.col("items.i"), lambda x: x.isNotNull())), none).alias("items"),
        (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"),
    )
    return out.drop("row")


def hit_positions(spans: Column) -> Column:
    """The distinct positions of words that spans cover."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))


def remove_hits(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", n: int = 10, drop_share: float = 0.8) -> DataFrame:
    """``docs`` without the words that hits cover, and what stands in front of each; the rest stays as it was.

    A document of which hits cover ``drop_share`` of the words or more is removed. Documents
    without hits are returned as they are. Columns of any names are kept.
    """
    t = _shared.column(text).cast("string")
    rows = docs.select(_shared.packed(docs.columns).alias("row"), _shared.column(id).alias("id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    hits = _looked_up(docs, benchmark_windows(items, n=n), id, text, False).groupBy("id", "text_hash").agg(F.collect_set(F.struct("pos", "len")).alias("spans"))
    hits = hits.select(F.col("id").alias("id2"), F.col("text_hash").alias("hash2"), hit_positions(F.col("spans")).alias("at"))
    both = rows.join(hits, F.col("id").eqNullSafe(F.col("id2")) & (F.col("text_hash") == F.col("hash2")), "left")
    words = F.when(F.col("at").isNotNull(), F.array_remove(F.split("text", _GAP_ANY_CASE), ""))
    gaps = F.when(F.col("at").isNotNull(), F.split("text", _WORD_ANY_CASE))
    both = both.select("row", "text", "at", words.alias("words"), gaps.alias("gaps"))
    both = both.where(F.col("at").isNull() | (F.size("at") < drop_share * F.size("words")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), F.col("at"))
    rest = F.concat(F.array_join(F.transform(kept, lambda i: F.concat(F.get("gaps", i), F.get("words", i))), ""), F.element_at("gaps", -1))
    names = [F.when(F.col("at").isNull(), F.col("text")).otherwise(rest).alias(text) if c == text else x for c, x in zip(docs.columns, _shared.unpacked(docs.columns), strict=True)]
    return both.select(*names)
