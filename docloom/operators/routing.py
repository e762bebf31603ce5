"""What a batch run does with documents: reading mode, redaction of whole documents, release, totals and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import known_values, pii, quality
from docloom.functions import normalise as N
from docloom.operators.components import reliable


def detect_with(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str) -> DataFrame:
    """The plug point for a detector: ``fn`` maps batches of rows to batches of results of a fixed schema."""
    return df.mapInPandas(fn, schema)


def route_text_or_scan(pages: DataFrame, id: str = "doc_id", least: int = 50) -> DataFrame:
    """id, route: ``text`` where the first three pages average enough characters and their text layer is reliable, else ``scan``."""
    first = pages.where("page_no <= 3")
    by = first.groupBy(id).agg(F.avg(F.length(N.strip(N.text("text")))).alias("avg"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: N.text(p["text"])), "\n").alias("joined"))
    reliable = ~quality.text_layer_unreliable("joined")
    return by.select(id, F.when((F.col("avg") >= least) & reliable, "text").otherwise("scan").alias("route"))


def first_usable_over_batches(batches: DataFrame, fields: list[str], lists: list[str], id: str = "doc_id") -> DataFrame:
    """Per document: of each scalar field the first batch's value that is not blank, of each list field all batches' lists in order."""
    usable = lambda f: F.trim(N.text(f)) != ""
    scalars = [F.coalesce(F.min_by(F.when(usable(f), F.col(f)), F.when(usable(f), F.col("batch_no"))), F.lit("")).alias(f) for f in fields]
    joined = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch_no", F.col(f).alias("v")))), lambda b: b["v"])).alias(f) for f in lists]
    return batches.groupBy(id).agg(*scalars, *joined)


def best_attempt(attempts: DataFrame, key: list[str], result: str = "reply", chars: str = "chars", tokens: str = "tokens") -> DataFrame:
    """Per batch: the attempt with the most text (the first of equals), and the tokens of all attempts."""
    return attempts.groupBy(*key).agg(F.max_by(result, F.struct(F.col(chars), -F.col("attempt"))).alias(result), F.max(chars).alias(chars), F.sum(tokens).alias(tokens))


def pii_types(findings: DataFrame, id: str = "doc_id") -> DataFrame:
    """The sorted distinct types of findings of each document."""
    return findings.groupBy(id).agg(F.array_sort(F.collect_set("type")).alias("types"))


def redact_document(pages: DataFrame, values: DataFrame, id: str = "doc_id", token: str = pii.TOKEN) -> DataFrame:
    """id, page_no, text, hits, unmatched: each page redacted with the names found anywhere in its document.

    Pages are joined with form feeds, so a name across a page break is found, and split again. Values and
    pages meet on the document's id; the pages of one document are one value by nature.
    """
    page = F.array_sort(F.collect_list(F.struct("page_no", N.text("text").alias("text"))))
    whole = pages.groupBy(id).agg(page.alias("p"))
    named = values.groupBy(id).agg(F.collect_set("value").alias("values"))
    none = F.array().cast("array<string>")
    j = whole.join(named, id, "left").withColumn("values", F.coalesce("values", none))
    joined = F.array_join(F.transform("p", lambda x: x["text"]), pii.PAGE_BREAK)
    red = j.withColumn("r", pii.redact_names(joined, F.col("values"), token))
    split = red.select(id, "p", F.col("r.hits").alias("name_hits"), F.col("r.unmatched").alias("unmatched"), F.posexplode(F.split("r.text", pii.PAGE_BREAK)).alias("i", "t"))
    out = split.withColumn("s", pii.redact_structured("t", token))
    return out.select(id, F.get(F.col("p"), F.col("i"))["page_no"].alias("page_no"), F.col("s.text").alias("text"), F.col("s.hits").alias("structured_hits"), "name_hits", F.array_sort("unmatched").alias("unmatched"))


def unmatched_values(flagged: DataFrame, matched: DataFrame, id: str = "doc_id") -> DataFrame:
    """Values flagged in a document and found on none of its pages, sorted."""
    left = flagged.select(id, "value").distinct().join(matched.select(id, "value"), [id, "value"], "left_anti")
    return left.groupBy(id).agg(F.array_sort(F.collect_set("value")).alias("unmatched"))


def corpus_audit(files: DataFrame) -> DataFrame:
    """``files`` (name, format, kind, text, ...) with chars, text_hash, first_name (first file of that text) and is_duplicate.

    One row per text is aggregated first; files without text are copies of nothing.
    """
    measured = files.withColumns({"chars": F.length(N.strip(N.text("text"))), "text_hash": F.sha2(N.text("text"), 256)})
    first = measured.where("chars > 0").groupBy("text_hash").agg(F.min("name").alias("first_name"))
    return measured.join(first, "text_hash", "left").withColumn("is_duplicate", F.coalesce(F.col("first_name") != F.col("name"), F.lit(False)))


def audit_totals(audited: DataFrame) -> DataFrame:
    """Totals over all, by format, by kind and by chamber in one pass (``null`` where a column is not grouped by)."""
    sets = audited.groupingSets([["format"], ["kind"], ["chamber"], []], "format", "kind", "chamber")
    return sets.agg(
        F.grouping_id("format", "kind", "chamber").cast("int").alias("level"),
        F.count("*").alias("files"),
        F.count_if(F.col("chars") == 0).alias("empty"),
        F.count_if(F.col("is_duplicate")).alias("duplicates"),
        F.sum("chars").alias("chars"),
    )


def requeue_damaged(delivered: DataFrame, sidecars: DataFrame, id: str = "doc_id", token: str = pii.TOKEN) -> DataFrame:
    """id, reason: delivered documents that are empty or partial, or (without a sidecar) cut words where the token stands before a letter."""
    glued = F.col("text").rlike(f"{token}[ء-ؿف-ي]")
    marked = delivered.join(sidecars.select(id, F.lit(True).alias("_side")), id, "left")
    size = quality.completeness(quality.visible_chars("text"), F.col("pages"))
    reason = F.when(size != "", size).when(F.col("_side").isNull() & glued, "cut-words").otherwise("")
    return marked.select(id, reason.alias("reason")).where("reason <> ''")


def run_totals(state: DataFrame) -> DataFrame:
    """Documents, pages and personal data of what is done; tokens and cost of everything."""
    done = F.col("status") == "done"
    return state.agg(
        F.count_if(done).alias("documents"),
        F.coalesce(F.sum(F.when(done, F.col("pages"))), F.lit(0)).alias("pages"),
        F.coalesce(F.sum(F.when(done, F.col("pii_count"))), F.lit(0)).alias("pii"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
    )


def run_report(records: DataFrame, fields: list[str], projected: int = 2000) -> DataFrame:
    """Cost per file and projected, documents held back and blocked, and how many delivered records have each field."""
    sent = ~F.col("quarantined")
    cost, n = F.sum("cost"), F.count("*")
    return records.agg(
        n.alias("documents"),
        F.count_if(F.col("quarantined")).alias("quarantined"),
        F.count_if(~F.col("leak_passed")).alias("leaked_blocked"),
        F.round(cost, 4).alias("cost_total"),
        F.round(cost / n, 6).alias("cost_per_file"),
        F.round(cost / n * projected, 2).alias("projected"),
        F.count_if(sent).alias("delivered"),
        *[F.count_if(sent & ~N.text(f).isin("", N.UNKNOWN)).alias(f"has_{f}") for f in fields],
    )


def budget_cutoff(rows: DataFrame, budget: float, order: str = "seq", cost: str = "cost") -> DataFrame:
    """The rows up to and including the one that crosses the budget, in order (then by cost, where several rows have one place).

    A two-level prefix sum over the two columns it needs: they are ranged by ``order`` and kept, as ranges may
    be drawn anew each time they are planned; each range is summed, and only the sums (one row per range) are
    accumulated in one place. What it finds is one place in the order, by which the rows are filtered.
    """
    narrow = rows.select(F.col(order).alias("o"), F.coalesce(F.col(cost), F.lit(0)).alias("c"))
    ranged = reliable(narrow.repartitionByRange("o").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("c").alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"))
    within = F.sum("c").over(Window.partitionBy("part").orderBy("o", "c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    spent = ranged.withColumn("within", within).join(F.broadcast(before), "part").where(F.col("before") + F.col("within") < budget)
    last = spent.groupBy("o").agg(F.count("*").alias("n")).orderBy(F.desc_nulls_last("o")).first()  # a top-1 plan
    if last is None:
        return rows.limit(0)
    whole, edge = (F.col(order) < F.lit(last["o"])) | F.col(order).isNull(), F.col(order) == F.lit(last["o"])
    if last["o"] is None:
        whole, edge = F.lit(False), F.col(order).isNull()
    return rows.where(whole).unionByName(rows.where(edge).orderBy(F.coalesce(F.col(cost), F.lit(0))).limit(last["n"]))


#: So many known values are looked for in one pass over the texts.
LEAK_VALUES = 50_000


def _value_blocks(values: DataFrame) -> list[known_values.KnownValues]:
    """Prepared values in blocks of about LEAK_VALUES."""
    values = reliable(values.select("value").where("value is not null").distinct())
    blocks = max(1, -(-values.count() // LEAK_VALUES))
    return [known_values.prepare(values.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == k)) for k in range(blocks)]


def _spread(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Texts dealt to tasks anew: a scan costs far more than a shuffle, and a file whose rows are few groups is read by few tasks."""
    return docs.select(id, text).repartition(F.xxhash64(id, text))


def known_value_leaks(docs: DataFrame, values: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, passed, hits, leaked: the leak gate with one list of values for all texts.

    ``values`` (column value) are sent in blocks of about LEAK_VALUES, each an automaton and a pass over the texts;
    results of several blocks are put together by id. Only values that the automaton finds are scanned with patterns.
    """
    docs = _spread(docs, id, text)
    scans = [docs.select(id, known_values.leak_scan_known(text, known).alias("r")) for known in _value_blocks(values)]
    if len(scans) == 1:
        return scans[0].select(id, "r.passed", "r.hits", "r.leaked")
    every = reduce(DataFrame.unionByName, scans)
    return every.groupBy(id).agg(F.bool_and("r.passed").alias("passed"), F.sum("r.hits").cast("int").alias("hits"), F.array_sort(F.flatten(F.collect_list("r.leaked"))).alias("leaked"))


def literal_value_leaks(docs: DataFrame, values: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, passed, leaked: as ``known_value_leaks`` with only those values that a text holds as they are written."""
    docs = _spread(docs, id, text)
    scans = [docs.select(id, known_values.literal_known(text, known).alias("leaked")) for known in _value_blocks(values)]
    every = scans[0] if len(scans) == 1 else reduce(DataFrame.unionByName, scans).groupBy(id).agg(F.array_sort(F.flatten(F.collect_list("leaked"))).alias("leaked"))
    return every.select(id, (F.size("leaked") == 0).alias("passed"), "leaked")


def redact_known_values(docs: DataFrame, values: DataFrame, text: str = "text", token: str = pii.TOKEN) -> DataFrame:
    """``docs`` with its text redacted with one list of values for all texts, replaced (the values found) and hits.

    Blocks of values are redacted one after the other, so of values in different blocks a shorter one may go first.
    """
    for i, known in enumerate(_value_blocks(values)):
        r = docs.withColumn("_r", known_values.redact_known(text, known, token))
        before = (F.concat("replaced", "_r.replaced"), F.col("hits") + F.col("_r.hits")) if i else (F.col("_r.replaced"), F.col("_r.hits"))
        docs = r.withColumns({text: F.col("_r.text"), "replaced": before[0], "hits": before[1]}).drop("_r")
    return docs


def seeded_sample(docs: DataFrame, n: int, seed: int, id: str = "doc_id") -> DataFrame:
    """A reproducible draw of ``n`` rows, in the order of ids."""
    return docs.orderBy(F.md5(F.concat_ws(":", F.col(id).cast("string"), F.lit(str(seed)))), id).limit(n).orderBy(id)


def limit_n(docs: DataFrame, n: int, id: str = "doc_id") -> DataFrame:
    return docs.orderBy(id).limit(n)


def spread_sample(records: DataFrame, n: int, chamber: str = "chamber", year: str = "year", id: str = "doc_id") -> DataFrame:
    """``n`` rows over all chambers in turn: within a chamber one of each year first, then the rest. Ids are unique.

    A year's first row is found by a minimum, and no chamber gives more than its first ``n`` rows, which a task holds to before it
    sends any, so no task sees a whole chamber.
    """
    own = [F.col(chamber).alias("_chamber"), F.col(year).alias("_year")]
    first = records.groupBy(*own).agg(F.min(F.struct("city", id)).alias("_first"))
    sizes = records.groupBy(F.col(chamber).alias("_of")).agg(F.count("*").alias("_size"))
    marked = records.join(first, F.col(chamber).eqNullSafe(F.col("_chamber")) & F.col(year).eqNullSafe(F.col("_year")))
    marked = marked.withColumn("_again", (~F.struct("city", id).eqNullSafe(F.col("_first"))).cast("int")).drop("_chamber", "_year", "_first")
    turn = F.row_number().over(Window.partitionBy(chamber).orderBy("_again", year, "city", id))
    few = marked.withColumn("_turn", turn).where(F.col("_turn") <= n)
    drawn = few.join(sizes, F.col(chamber).eqNullSafe(F.col("_of")))
    return drawn.orderBy("_turn", F.desc("_size"), chamber).limit(n).drop("_again", "_turn", "_size", "_of")
