"""Byte-identical copies: fingerprints, which copy is kept, and what happens to those processed before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_cache(files: DataFrame, cache: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with their hashes: the cached one while path, length and modification time agree, else computed anew."""
    key = ["path", "length", "modificationTime"]
    joined = files.join(cache.select(*key, F.col("hash").alias("_cached")), key, "left")
    # md5 is evaluated only where no cached hash was found
    return joined.withColumns({"hash": F.coalesce("_cached", F.md5(content)), "reused": F.col("_cached").isNotNull()}).drop("_cached")


def split_copies(docs: DataFrame, known: DataFrame, done: DataFrame, id: str = "doc_id", hash: str = "hash") -> DataFrame:
    """``docs`` (id, hash, ...) with ``original`` and ``is_copy``.

    ``known``: stored hash and doc_id. If the stored document of a hash is none of the group's own, all
    are its copies; else the original is the stored document, else the smallest that is done, else the
    smallest. One small row per hash is aggregated before anything is joined, so a hot hash costs no sort.
    """
    stored = known.groupBy(F.col("hash").alias("_h")).agg(F.min("doc_id").alias("_stored"))
    finished = done.select(F.col("doc_id").alias(id), F.lit(True).alias("_done")).distinct()
    marked = docs.join(finished, id, "left")
    best = marked.groupBy(F.col(hash).alias("_h")).agg(F.min(F.struct(F.col("_done").isNull(), F.col(id)))[id].alias("_best"))
    own = docs.select(F.col(hash).alias("_h"), F.col(id).alias("_stored")).distinct()
    inside = stored.join(own, ["_h", "_stored"], "left_semi")
    outside = stored.join(inside, "_h", "left_anti")
    original = best.join(inside.withColumnRenamed("_stored", "_in"), "_h", "left").join(outside.withColumnRenamed("_stored", "_out"), "_h", "left").select("_h", F.coalesce("_out", "_in", "_best").alias("original"))
    return docs.join(original, docs[hash] == original["_h"]).drop("_h").withColumn("is_copy", F.col(id) != F.col("original"))


def copy_count(docs: DataFrame, hash: str = "hash") -> DataFrame:
    """files, distinct texts and copies."""
    return docs.agg(F.count("*").alias("files"), F.countDistinct(hash).alias("originals")).withColumn("copies", F.col("files") - F.col("originals"))


def skip_done(docs: DataFrame, state: DataFrame, id: str = "doc_id") -> DataFrame:
    """The documents that are not done yet, or whose output is missing."""
    return docs.join(state.where((F.col("status") == "done") & (F.coalesce("output", F.lit("")) != "")).select(id), id, "left_anti")


def retire_copies(state: DataFrame, copies: DataFrame, id: str = "doc_id") -> DataFrame:
    """``state`` with copies marked as duplicates of their original; their cost is kept."""
    named = copies.select(F.col(id), F.col("original").alias("_of"))
    j = state.join(named, id, "left")
    is_copy = F.col("_of").isNotNull()
    return j.withColumns({"status": F.when(is_copy, "duplicate").otherwise(F.col("status")), "error": F.when(is_copy, F.concat(F.lit("copy of "), F.col("_of").cast("string"))).otherwise(F.col("error"))}).drop("_of")


def without_copies(rows: DataFrame, copies: DataFrame, id: str = "doc_id") -> DataFrame:
    """Case rows or references without those of copies."""
    return rows.join(copies.select(id), id, "left_anti")
