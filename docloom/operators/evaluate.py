"""Scores of a delivered run against annotated truth, over all, by format and by chamber."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import normalise as N
from docloom.functions import pii


def truth_vs_records(truth: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth with its records, and the annotated documents without a record."""
    return truth.join(records, "doc_id"), truth.join(records.select("doc_id"), "doc_id", "left_anti").select("doc_id")


def score_documents(joined: DataFrame, fields: list[str]) -> DataFrame:
    """Per document, what was right of what.

    ``joined``: format, chamber, quarantined, text, pii, kept_terms, links and truth_links, category, and
    for each field its value and ``truth_`` value.
    """
    flat = N.norm_eval("text")
    leak = pii.leak_scan("text", F.col("pii"))
    values = F.size(F.array_distinct("pii"))
    right = lambda f: ((N.norm_eval(f) == N.norm_eval(f"truth_{f}")) & (N.norm_eval(f"truth_{f}") != "")).cast("int")
    return joined.select(
        "doc_id",
        "format",
        "chamber",
        F.col("quarantined").cast("int").alias("quarantined"),
        values.alias("pii_total"),
        (values - F.size(leak["leaked"])).alias("pii_removed"),
        F.size("kept_terms").alias("kept_total"),
        F.size(F.filter("kept_terms", lambda t: F.contains(flat, N.norm_eval(t)))).alias("kept_present"),
        *[right(f).alias(f"{f}_ok") for f in fields],
        (N.norm_eval("category") == N.norm_eval("chamber")).cast("int").alias("category_ok"),
        F.size(F.array_intersect("links", "truth_links")).alias("link_tp"),
        F.size(F.array_except("links", "truth_links")).alias("link_fp"),
        F.size(F.array_except("truth_links", "links")).alias("link_fn"),
    )


def metrics(scores: DataFrame, fields: list[str]) -> DataFrame:
    """One row over all, per format and per chamber; a share of nothing is 100."""
    rate = lambda ok, of: F.round(F.coalesce(100 * F.sum(ok) / F.nullif(F.sum(of), F.lit(0)), F.lit(100.0)), 2)
    sets = scores.groupingSets([["format"], ["chamber"], []], "format", "chamber")
    return sets.agg(
        F.grouping_id("format", "chamber").cast("int").alias("level"),
        F.count("*").alias("docs"),
        rate("pii_removed", "pii_total").alias("pii_recall"),
        rate("kept_present", "kept_total").alias("kept_precision"),
        *[F.round(100 * F.avg(f"{f}_ok"), 2).alias(f"{f}_accuracy") for f in fields],
        F.round(100 * F.avg("category_ok"), 2).alias("category_accuracy"),
        rate("link_tp", F.col("link_tp") + F.col("link_fp")).alias("link_precision"),
        rate("link_tp", F.col("link_tp") + F.col("link_fn")).alias("link_recall"),
        F.round(100 * F.avg("quarantined"), 2).alias("quarantine_rate"),
    )
