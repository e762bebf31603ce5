"""Links and cases kept in step with changing documents: only what a batch touches is worked out again.

The state is four tables: ``docs`` and ``refs`` as they came, ``edges`` (each reference's best link), ``cases`` (doc_id, component,
case_id, review) and nothing that depends on the order of arrival. A batch replaces documents with all their references, adds
new ones and removes others. What it can change is found by keys:

- references of replaced and new documents, and references that share a key with an old or a new version of a document of
  the batch, are linked anew; all others have the candidates they had;
- components that hold a document of the batch, or an end of an edge that came or went, are built anew from their own edges, so
  a component falls apart when what held it together goes.

The state after any sequence of batches is what one full run over the same documents gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import linkage as L
from docloom.operators.components import stored

EDGES = "parent_doc {id}, child_doc {id}, confidence string, score int, ref_ix int"
CASES = "doc_id {id}, case_id string, review string, component {id}"


def empty_state(docs: DataFrame, refs: DataFrame) -> dict[str, DataFrame]:
    """A state without documents, for documents and references of these schemas."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    made = lambda ddl: spark.createDataFrame([], ddl.format(id=kind))
    return {"docs": docs.limit(0), "refs": refs.limit(0), "edges": made(EDGES), "cases": made(CASES)}


def _without(df: DataFrame, gone: DataFrame, column: str = "doc_id") -> DataFrame:
    return df.join(gone.withColumnRenamed("doc_id", column), column, "left_anti")


def full_state(docs: DataFrame, refs: DataFrame, as_of_year: int) -> dict[str, DataFrame]:
    """The state of these documents, worked out as a whole."""
    edges = stored(L.relink(docs, refs, as_of_year, "ref_ix"))
    return {"docs": docs, "refs": refs, "edges": edges, "cases": L.connected_cases(docs, edges, as_of_year, "component")}


def apply_batch(state: dict[str, DataFrame], docs: DataFrame, refs: DataFrame, removed: DataFrame, as_of_year: int) -> dict[str, DataFrame]:
    """The state after a batch: ``docs`` (one row for each id) with all their ``refs`` are put in, ``removed`` (doc_id) are taken out.

    An id that is put in and taken out in one batch is put in. References of documents that are not in the batch are ignored.
    """
    columns = {k: state[k].columns for k in state}
    docs = docs.select(columns["docs"])
    refs = refs.select(columns["refs"]).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select(columns["refs"])
    changed = stored(docs.select("doc_id").union(removed.select("doc_id")).where("doc_id is not null").distinct())
    flagged = lambda df, fresh: df.withColumn("_fresh", F.lit(fresh))
    all_docs = stored(flagged(_without(state["docs"], changed), False).unionByName(flagged(docs, True)))
    all_refs = stored(flagged(_without(state["refs"], changed), False).unionByName(flagged(refs, True)))
    # what linking reads of a row is worked out once, and every step below reads little more than keys and ids
    own = stored(L.document_facts(all_docs, as_of_year, "_fresh"))

    # references whose candidates may have changed: those of the batch, and those that share a key with its documents as they were or are
    before = state["docs"].join(changed, "doc_id", "left_semi")
    keys = L.link_keys(before, as_of_year).union(L.fact_keys(own.where("_fresh"))).distinct()
    old_refs = all_refs.where("NOT _fresh")
    met = stored(L.link_keys(old_refs, as_of_year, "doc_id", "ref_ix").join(keys, "key", "left_semi").select("doc_id", "ref_ix").distinct())
    asked = all_refs.where("_fresh").unionByName(old_refs.join(met, ["doc_id", "ref_ix"], "left_semi").select(all_refs.columns))
    asked = stored(L.reference_facts(asked, own, as_of_year))
    found = L.links(own, asked, "ref_ix")

    # a reference's edge as it was and as it is; that of a reference that is not asked, and whose document is not of the batch, stays
    at = ["parent_doc", "ref_ix"]
    was = state["edges"].join(changed.select(F.col("doc_id").alias("parent_doc"), F.lit(True).alias("gone")), "parent_doc", "left")
    was = was.withColumnsRenamed({"child_doc": "old_child", "confidence": "old_confidence", "score": "old_score"})
    new = asked.select(F.col("doc_id").alias("parent_doc"), "ref_ix", F.lit(True).alias("again")).join(found, at, "left")
    stays = F.col("gone").isNull() & F.col("again").isNull()
    pick = lambda old, new: F.when(stays, F.col(old)).otherwise(F.col(new)).alias(new)
    same = F.col("child_doc").eqNullSafe(F.col("old_child")) & F.col("confidence").eqNullSafe(F.col("old_confidence")) & F.col("score").eqNullSafe(F.col("old_score"))
    both = stored(was.join(new, at, "full_outer").select(*at, pick("old_child", "child_doc"), pick("old_confidence", "confidence"), pick("old_score", "score"), F.when(stays, False).otherwise(~same).alias("moved"), "old_child").where("child_doc is not null OR moved"))
    edges = both.where("child_doc is not null").select(columns["edges"])

    # components that lose or gain something; an edge that goes and comes back as it was touches none
    ends = both.where("moved").select(F.explode(F.array("parent_doc", "child_doc", "old_child")).alias("doc_id")).where("doc_id is not null")
    touched = changed.union(ends)
    cases = state["cases"]
    hit = cases.join(touched, "doc_id", "left_semi").select("component").distinct()
    region = stored(cases.join(hit, "component", "left_semi").select("doc_id").union(touched).distinct())
    # an edge's ends are in one component now and were in one before, or it is new: one end tells where it belongs
    inside = edges.join(region.withColumnRenamed("doc_id", "parent_doc"), "parent_doc", "left_semi").select(columns["edges"])
    known = own.select(F.col("child").alias("doc_id"), F.col("child_rank").alias("rank"), F.col("d_file").alias("no"))
    rebuilt = L.cases_of(known.join(region, "doc_id", "left_semi"), inside, "component")
    new_cases = _without(cases, region).select(columns["cases"]).unionByName(rebuilt.select(columns["cases"]))
    return {"docs": all_docs.select(columns["docs"]), "refs": all_refs.select(columns["refs"]), "edges": edges, "cases": new_cases}
