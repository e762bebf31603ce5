"""The vocabulary of subjects: what courts use, what is proposed, and what is approved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import extract as X
from docloom.functions import normalise as N
from docloom.operators.catalogue import commonest_label, latest_per


def theme_vocabulary(decisions: DataFrame) -> DataFrame:
    """key, label of the subjects that courts printed, by loose key."""
    own = decisions.where("theme_source = 'court'").select(N.loose_key("theme").alias("key"), "theme").where("key <> ''")
    return commonest_label(own, "key", "theme")


def chamber_vocabulary(decisions: DataFrame, n: int = 60) -> DataFrame:
    """category, theme_key, label: each chamber's commonest published subjects."""
    shown = decisions.where((F.col("state") == "published") & (N.text("theme_key") != ""))
    by = shown.groupBy("category", "theme_key", "theme").agg(F.count("*").alias("_n"))
    label = by.groupBy("category", "theme_key").agg(F.min_by("theme", F.struct(-F.col("_n"), F.col("theme"))).alias("label"), F.sum("_n").alias("n"))
    return latest_per(label, "category", [F.desc("n"), F.col("theme_key")], n)


def classify_todo(decisions: DataFrame, least: int = 800) -> DataFrame:
    """Published decisions with text but neither subject nor abstract, by id."""
    return decisions.where((F.col("state") == "published") & (N.text("theme") == "") & (N.text("abstract") == "") & (F.length("body_text") > least)).select("doc_id").orderBy("doc_id")


def accept_theme(answers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``answers`` (doc_id, chamber, theme) with the vocabulary's label, null where it is only a proposal."""
    keyed = answers.withColumn("theme_key", N.theme_key("theme"))
    v = vocabulary.select(F.col("category").alias("chamber"), "theme_key", "label")
    return keyed.join(v, ["chamber", "theme_key"], "left")


def reconcile_proposals(proposals: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``proposals`` (doc_id, chamber, proposed) with their loose key and the existing subject, null where there is none."""
    keyed = proposals.withColumn("key", N.loose_key("proposed"))
    return keyed.join(vocabulary.select("key", F.col("label").alias("existing")), "key", "left")


def folded_in_counts(reconciled: DataFrame, n: int = 12) -> DataFrame:
    """The commonest pairs of a proposal and the subject it was folded into."""
    return reconciled.where("existing is not null").groupBy("proposed", "existing").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "proposed").limit(n)


def file_themes(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """``decisions`` with the subject of ``labels`` (doc_id, label) where they have none yet."""
    j = decisions.join(labels.select("doc_id", F.col("label").alias("_l")).dropDuplicates(["doc_id"]), "doc_id", "left")
    takes = (N.text("theme") == "") & F.col("_l").isNotNull()
    return j.withColumns({"theme": F.when(takes, F.col("_l")).otherwise(F.col("theme")), "theme_key": F.when(takes, N.theme_key("_l")).otherwise(F.col("theme_key")), "theme_source": F.when(takes, "model").otherwise(F.col("theme_source"))}).drop("_l")


def proposal_review(proposals: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """key, label, rulings, chambers (map of counts), also_spelled, approve: one row per loose key; earlier decisions are kept."""
    keyed = proposals.select(N.loose_key("proposed").alias("key"), "proposed", "chamber")
    spelt = keyed.groupBy("key", "proposed").agg(F.count("*").alias("n")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("proposed").alias("p")))), lambda x: x["p"]).alias("spellings"), F.sum("n").alias("rulings"))
    rooms = keyed.groupBy("key", "chamber").agg(F.count("*").alias("n")).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chamber", "n")))).alias("chambers"))
    out = spelt.join(rooms, "key").select("key", F.get("spellings", F.lit(0)).alias("label"), "rulings", "chambers", F.slice("spellings", F.lit(2), F.greatest(F.size("spellings") - 1, F.lit(0))).alias("also_spelled"))
    if previous is None:
        return out.withColumn("approve", F.lit(None).cast("boolean"))
    before = previous.select("key", F.col("approve"), F.col("label").alias("_label"))
    return out.join(before, "key", "left").withColumn("label", F.coalesce(F.nullif("_label", F.lit("")), "label")).drop("_label")


def apply_approvals(proposals: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labels to file (doc_id, label), and the proposals that are still undecided."""
    keyed = proposals.withColumn("key", N.loose_key("proposed"))
    j = keyed.join(review.select("key", "approve", "label"), "key", "left")
    return j.where("approve").select("doc_id", "label"), j.where(F.col("approve").isNull()).select(*proposals.columns)


def derive_from_stored(decisions: DataFrame) -> DataFrame:
    """``decisions`` with subject, rule and outcome read again from their texts.

    A subject that a model wrote is not replaced by none; everything else takes what is read.
    """
    note = X.headnote_fields(X.parse_headnote("body_text"))
    read = decisions.withColumns({"_h": note, "_o": X.outcome("body_text")})
    keep = (F.col("_h.theme") == "") & (F.col("theme_source") == "model")
    subject = {c: F.when(keep, F.col(c)).otherwise(F.col(f"_h.{c}")) for c in ("theme", "theme_key", "keywords") if c in decisions.columns}
    source = F.when(keep, F.col("theme_source")).otherwise(F.col("_h.theme_source"))
    return read.withColumns({**subject, "theme_source": source, "rule": F.col("_h.rule"), "outcome": F.col("_o")}).drop("_h", "_o")


def derive_coverage(decisions: DataFrame) -> DataFrame:
    n, share = F.count("*"), lambda c: F.round(100 * F.count_if(N.text(c) != "") / F.count("*"), 1)
    return decisions.agg(n.alias("rows"), share("theme").alias("with_subject"), share("rule").alias("with_rule"), share("outcome").alias("with_outcome"))
