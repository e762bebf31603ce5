"""A training corpus from raw documents, in five stages; each works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last
one adds how often each document is taken. ``run`` writes each stage as Parquet to the shared folder and
reads it back, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import _shared, decontaminate, language_id, mixing, ngram_join, suffix_dedup

#: A text is in none of the learned languages if even the best one's code is longer than so many bits a byte, by more than SLACK bits.
MOST_BITS = 5.0
SLACK = 128.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters, or whose code is too long in every language, go.

    Null and empty texts have no letters. Rows are judged one by one, repeated ones and those without an id alike.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # none of them is among what is added
    text = names[docs.columns.index("text")]
    known = language_id.identify(docs.toDF(*names), language_id.fit(docs), text)
    excess = (F.col("bits_per_byte") - MOST_BITS) * F.octet_length(text)
    return known.where((F.col("lang_pred") != "und") & (excess <= SLACK)).select(*names).toDF(*docs.columns)


def _one_id_each(rows: DataFrame) -> DataFrame:
    """``rows`` (id, h, ...) with an id for each pair of id and h, in their order; as they are where no id has several texts."""
    narrow = rows.select("id", "h").distinct()
    if narrow.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    # ranges are kept, as they may be drawn anew each time they are planned; one row for each range is added up in one place
    ranged = _shared.cut(narrow.repartitionByRange("id", "h").withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("part").orderBy("id", "h"))
    places = ranged.join(F.broadcast(before.drop("n")), "part").select("id", "h", place.alias("place"))
    return rows.join(places, ["id", "h"]).drop("id").withColumnRenamed("place", "id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id.

    Documents without an id come behind all others, in the order of a hash of their texts, so a group keeps one of
    them only if it has no other; ids from 2**62 are not used by others. Of rows with equal ids and texts the one whose other
    columns, as JSON, come first stays. Different texts of one id are documents of their own, in the order of a hash of the texts.
    Texts without words are linked with nothing.
    """
    id = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    other = F.to_json(_shared.packed([c for c in docs.columns if c != "text"]))
    rows = docs.select(_shared.packed(docs.columns).alias("all"), id.alias("id"), F.col("text"), F.xxhash64("text").alias("h"), other.alias("other"))
    rows = _one_id_each(rows)
    links = ngram_join.link_documents(rows.select("id", "text"), id="id", links_counted=False)
    first = links.where("id = component_id").select("id").distinct()
    kept = rows.drop("text").join(first, "id", "left_semi").groupBy("id", "h").agg(F.min_by("all", "other").alias("all"))
    return kept.select(*_shared.unpacked(docs.columns, "all"))


def _measured(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``df``, with n_chars as the text now is."""
    return df.select(*[F.length("text").cast(df.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 50 bytes that a smaller document has; those of which nothing is left go.

    Null and empty texts stay as they are. Rows without an id come behind all others; repeated rows keep their texts, as
    neither is smaller. Columns of any names are kept, those called as what the operator adds too.
    """
    names = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    kept = suffix_dedup.remove_repeated_bytes(docs.toDF(*names))
    kept = kept.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return _measured(kept.select(*names).toDF(*docs.columns), docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages; those that are mostly such passages go.

    Null and empty texts stay as they are; repeated rows and rows without an id are judged alike, by their texts.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(decontaminate.remove_hits(docs, items), docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the number of copies that the mix takes; columns called as what is added are replaced."""
    return mixing.mix_sources(docs, with_text=True)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources to target weights", mix_to_targets),
]

#: Trained models, iterations and rounding are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _shared.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
