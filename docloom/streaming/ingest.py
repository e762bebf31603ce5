"""Incremental ingestion: only new files each run, without copies of what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import pii
from docloom.operators import relinking
from docloom.operators.components import reliable
from docloom.operators.dedupe import split_copies
from docloom.sources.snapshots import SnapshotStore


def new_documents(batch: DataFrame, stored: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rows of a batch that are no copies: not of stored texts, nor of one another. Adds content_hash and clean."""
    hashed = batch.withColumn("content_hash", F.md5(F.coalesce("text", F.lit(""))))
    known = stored.select(F.col("content_hash").alias("hash"), F.col(id).alias("doc_id"))
    done = stored.select(F.col(id).alias("doc_id")).limit(0)
    kept = split_copies(hashed, known, done, id, "content_hash").where(~F.col("is_copy")).drop("original", "is_copy")
    return kept.withColumn("clean", F.size(pii.pii_gate("text")) == 0)


def incremental_ingest(spark: SparkSession, source: str, schema: T.StructType | str, stored: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, id: str = "doc_id", max_files: int = 1000) -> None:
    """Takes the files of ``source`` that no earlier run has taken, and hands the new documents to ``sink``.

    The anti-join against the stored table replaces state that would grow with every text ever seen. The
    sink gets the batch number and must replace what it wrote for the same number, as a batch may be run again.
    """

    def one(batch: DataFrame, number: int) -> None:
        sink(new_documents(batch, stored(), id), number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: What a file of rulings holds: a document with its references, or the removal of one. The row with the largest ``seq`` counts.
RULING = """doc_id string, seq long, removed boolean, text string, level string, court string, city string, decision_no string, date string, file_no string,
refs array<struct<court:string,city:string,decision_no:string,date:string,file_no:string>>"""


def link_batch(state: dict[str, DataFrame], batch: DataFrame, as_of_year: int) -> dict[str, DataFrame]:
    """The state of links and cases after a batch of rulings.

    Of rows with one id the last counts. A ruling whose text is a stored one's, or that of a ruling with a smaller id in the batch,
    is a copy: it is not put in, and what was stored under its id goes.
    """
    last = batch.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in batch.columns if c != "doc_id"]), "seq").alias("r")).select("doc_id", "r.*")
    last = reliable(last)
    removed = last.where("removed").select("doc_id")
    put = last.where("coalesce(removed, false) = false")
    # what this batch replaces or removes is no original any more
    stored = state["docs"].join(last.select("doc_id"), "doc_id", "left_anti")
    docs = reliable(new_documents(put, stored))
    copies = put.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti")
    refs = docs.select("doc_id", F.posexplode("refs").alias("ref_ix", "r")).select("doc_id", "ref_ix", "r.*")
    return relinking.apply_batch(state, docs.drop("seq", "removed", "refs"), refs, removed.union(copies), as_of_year)


def ingest_and_link(spark: SparkSession, source: str, root: str, checkpoint: str, as_of_year: int, schema: str = RULING, max_files: int = 1000) -> None:
    """Takes the new files of ``source`` and brings documents, references, links and cases in the store ``root`` up to them.

    All tables of a batch appear together in one version, which notes the batch: one that is run again after a crash
    changes nothing, whether it had been published or not.
    """

    def one(batch: DataFrame, number: int) -> None:
        store = SnapshotStore(spark, root)
        parent = store.version()
        if parent.notes.get("batch", -1) >= number:
            return
        if parent.number:
            state = store.tables(parent.number)
        else:
            docs = batch.limit(0).drop("seq", "removed", "refs").withColumns({"content_hash": F.lit(""), "clean": F.lit(True)})
            refs = batch.limit(0).select("doc_id", F.posexplode("refs").alias("ref_ix", "r")).select("doc_id", "ref_ix", "r.*")
            state = relinking.empty_state(docs, refs)
        store.commit(link_batch(state, batch, as_of_year), parent.number, {"batch": number})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(source)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
