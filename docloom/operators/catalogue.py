"""The catalogue of delivered decisions: gated imports, upserts, facets, pages, work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import normalise as N
from docloom.functions import pii
from docloom.operators.pages import page

STATES = ["imported", "under_review", "published", "withdrawn"]


def gated_import(records: DataFrame, texts: DataFrame, stored: DataFrame) -> DataFrame:
    """Each record with its text and ``import_outcome``.

    ``texts``: doc_id, text, error. In this order: held_by_pipeline, no_file, unreadable, gate_quarantined,
    kept_edited, updated, imported.
    """
    t = texts.select("doc_id", F.col("text").alias("body_text"), F.col("error").alias("_error"), F.lit(True).alias("_file"))
    s = stored.select("doc_id", F.col("edited_at").isNotNull().alias("_edited"), F.lit(True).alias("_stored"))
    j = records.join(t, "doc_id", "left").join(s, "doc_id", "left")
    outcome = (
        F.when(F.coalesce("quarantined", F.lit(False)) | (F.col("status") != "done"), "held_by_pipeline")
        .when(F.col("_file").isNull(), "no_file")
        .when(N.text("_error") != "", "unreadable")
        .when(F.size(pii.pii_gate("body_text")) > 0, "gate_quarantined")
        .when(F.col("_edited"), "kept_edited")
        .when(F.col("_stored"), "updated")
        .otherwise("imported")
    )
    return j.withColumn("import_outcome", outcome).drop("_error", "_file", "_edited", "_stored")


def import_counts(imported: DataFrame) -> DataFrame:
    return imported.groupBy("import_outcome").agg(F.count("*").alias("n"))


def next_state(state: Column, publish: bool) -> Column:
    """The state of a re-imported decision: published if asked; else unknown and withdrawn ones are imported, published ones under review."""
    if publish:
        return F.lit("published")
    return F.when(~N.text(state).isin(*STATES) | (state == "withdrawn"), "imported").when(state == "published", "under_review").otherwise(state)


def upsert_decisions(stored: DataFrame, incoming: DataFrame, publish: bool = False) -> DataFrame:
    """A new snapshot: incoming rows replace stored ones by doc_id, except those edited by hand.

    Columns that only one side has are kept. sort_key and search_text are computed again.
    """
    both = [c for c in incoming.columns if c != "doc_id"]
    s = stored.select("doc_id", F.struct("*").alias("s"))
    i = incoming.select("doc_id", F.struct("*").alias("i"))
    j = s.join(i, "doc_id", "full_outer")
    edited = F.coalesce(F.col("s.edited_at").isNotNull(), F.lit(False))
    takes = F.col("i").isNotNull() & ~edited
    cols = []
    for c in dict.fromkeys([*stored.columns, *incoming.columns]):
        if c == "doc_id":
            cols.append(F.col("doc_id"))
        elif c in stored.columns:
            cols.append((F.when(takes, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")) if c in both else F.col(f"s.{c}")).alias(c))
        else:
            cols.append(F.col(f"i.{c}").alias(c))
    out = j.select(*cols, takes.alias("_takes"), F.col("s.state").alias("_was"))
    state = F.when(F.col("_takes"), next_state(F.col("_was"), publish)).otherwise(F.col("_was"))
    key = F.when(F.col("_takes"), N.sort_key("decision_date", "decision_no")).otherwise(F.col("sort_key"))
    search = F.when(F.col("_takes"), N.norm_search("body_text")).otherwise(F.col("search_text"))
    return out.withColumns({"state": state, "sort_key": key, "search_text": search}).drop("_takes", "_was")


def enrichment_apply(stored: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """``stored`` with the fields of ``rows``; hand-edited decisions keep theirs. Adds ``enriched``: changed, same, skipped or empty."""
    r = rows.select("doc_id", F.struct(*fields).alias("r"))
    j = stored.join(r, "doc_id", "left")
    edited, has = F.col("edited_at").isNotNull(), F.col("r").isNotNull()
    differs = ~F.struct(*[N.text(f).alias(f) for f in fields]).eqNullSafe(F.struct(*[N.text(F.col(f"r.{f}")).alias(f) for f in fields]))
    kind = F.when(~has, "").when(edited, "skipped").when(differs, "changed").otherwise("same")
    out = j.withColumn("enriched", kind)
    return out.withColumns({f: F.when(F.col("enriched") == "changed", F.col(f"r.{f}")).otherwise(F.col(f)) for f in fields}).drop("r")


def enrichment_export(decisions: DataFrame, fields: list[str]) -> DataFrame:
    """The derived columns of decisions that have a subject, an abstract or a rule, by id."""
    any_ = (N.text("theme") != "") | (N.text("abstract") != "") | (N.text("rule") != "")
    return decisions.where(any_).select("doc_id", *fields).orderBy("doc_id")


def browse_tree(decisions: DataFrame, states: list[str] = ["published"]) -> DataFrame:  # noqa: B006
    """court, chamber, n, court_total: largest courts and chambers first; a court without a name is named by its level."""
    named = F.when(N.text("court") != "", F.col("court")).when(F.col("level") == N.APPEAL, "محكمة الاستئناف").when(F.col("level") == N.FIRST_INSTANCE, "المحكمة الابتدائية").otherwise("محكمة النقض")
    shown = decisions.where(F.col("state").isin(states)).select(named.alias("court"), F.col("category").alias("chamber"))
    by = shown.groupBy("court", "chamber").agg(F.count("*").alias("n"))
    return by.withColumn("court_total", F.sum("n").over(Window.partitionBy("court"))).orderBy(F.desc("court_total"), "court", F.desc("n"), "chamber")


def _facet(decisions: DataFrame, column: str, chamber: str, states: list[str]) -> DataFrame:
    shown = decisions.where(F.col("state").isin(states) & (N.text(column) != ""))
    if chamber:
        shown = shown.where(F.col("category") == chamber)
    return shown.groupBy(column).agg(F.count("*").alias("n"))


def browse_years(decisions: DataFrame, chamber: str = "", states: list[str] = ["published"]) -> DataFrame:  # noqa: B006
    return _facet(decisions, "year", chamber, states).orderBy(F.desc("year"))


def browse_cities(decisions: DataFrame, chamber: str = "", states: list[str] = ["published"]) -> DataFrame:  # noqa: B006
    return _facet(decisions, "city", chamber, states).orderBy(F.desc("n"), "city")


def commonest_label(rows: DataFrame, key: str, label: str) -> DataFrame:
    """key, label (its commonest spelling, the first of equals), n, spellings counted before."""
    by = rows.groupBy(key, label).agg(F.count("*").alias("_n"))
    return by.groupBy(key).agg(F.min_by(F.col(label), F.struct(-F.col("_n"), F.col(label))).alias("label"), F.sum("_n").alias("n"))


def browse_themes(decisions: DataFrame, chamber: str = "", states: list[str] = ["published"], limit: int = 300) -> DataFrame:  # noqa: B006
    """theme_key, label, n of the commonest subjects."""
    shown = decisions.where(F.col("state").isin(states) & (N.text("theme_key") != ""))
    if chamber:
        shown = shown.where(F.col("category") == chamber)
    return commonest_label(shown, "theme_key", "theme").orderBy(F.desc("n"), "theme_key").limit(limit)


def platform_counts(decisions: DataFrame) -> DataFrame:
    state = F.col("state")
    return decisions.agg(F.count("*").alias("decisions"), F.count_if(state == "published").alias("published"), F.count_if(state.isin("imported", "under_review")).alias("pending"))


def listing_order(rows: DataFrame) -> DataFrame:
    """Rows in a portal's order: chamber, year, month, day, decision number as a number, id. Sorted by ranges."""
    d = N.text("date_display")
    number = F.coalesce(F.col("decision_display").try_cast("long"), F.lit(0))
    keys = {"_y": F.substring(d, 7, 4), "_m": F.substring(d, 4, 2), "_d": F.substring(d, 1, 2), "_n": number}
    return rows.withColumns(keys).orderBy("category", "_y", "_m", "_d", "_n", "doc_id").drop(*keys)


def browse_rulings(decisions: DataFrame, chamber: str = "", year: str = "", city: str = "", theme: str = "", match: Column | None = None, number: str = "", states: list[str] = ["published"], limit: int = 50, offset: int = 0) -> DataFrame:  # noqa: B006
    """One page of a listing, newest first, with ``total``. A bare number puts the decision of that number first."""
    shown = decisions.where(F.col("state").isin(states))
    for column, value in (("category", chamber), ("year", year), ("city", city), ("theme_key", theme)):
        if value:
            shown = shown.where(F.col(column) == value)
    if match is not None:
        shown = shown.where(match)
    total = shown.agg(F.count("*").alias("total"))
    exact = [(F.when(F.col("decision_no") == number, 0).otherwise(1), True)] if number else []
    found = page(shown, [*exact, (F.col("sort_key"), False), (F.col("doc_id"), True)], offset, limit)
    return found.crossJoin(F.broadcast(total))  # one row


def list_decisions(decisions: DataFrame, states: list[str] | None = None, category: str = "", level: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    shown = decisions if states is None else decisions.where(F.col("state").isin(states))
    for column, value in (("category", category), ("level", level)):
        if value:
            shown = shown.where(F.col(column) == value)
    return page(shown, [(F.col("updated_at"), False), (F.col("doc_id"), True)], offset, limit)


def work_queue(decisions: DataFrame) -> DataFrame:
    """Unpublished decisions with the reasons to look at them."""
    reasons = F.filter(
        F.array(
            F.when(F.col("review") == "check", "low-confidence link"),
            F.when(N.text("category").isin("", N.UNKNOWN), "missing category"),
            F.when((N.text("decision_no") == "") | (N.text("file_no") == ""), "missing identifier"),
        ),
        lambda r: r.isNotNull(),
    )
    queue = decisions.where(F.col("state").isin("imported", "under_review")).withColumn("reasons", reasons)
    return queue.withColumn("reasons", F.when(F.size("reasons") == 0, F.array(F.lit("needs review"))).otherwise(F.col("reasons"))).orderBy(F.desc("updated_at"), "doc_id")


def latest_per(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in order; tasks drop the others before the shuffle."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_r") <= n).drop("_r")


def latest_activity(events: DataFrame, n: int = 5, actor: str = "actor") -> DataFrame:
    return latest_per(events, actor, [F.desc("ts"), F.col("event_id")], n)


def audit_trail(audit: DataFrame, entity_id: str) -> DataFrame:
    return audit.where(F.col("entity_id") == entity_id).orderBy(F.desc("ts"))


def open_reports_cap(reports: DataFrame, new: DataFrame, most: int = 50) -> DataFrame:
    """``new`` reports with ``accepted``: a reader may have ``most`` open ones; earlier reports go first."""
    open_ = reports.where("status = 'open'").groupBy("reporter").agg(F.count("*").alias("_open"))
    ranked = new.withColumn("_r", F.row_number().over(Window.partitionBy("reporter").orderBy("ts", "report_id")))
    return ranked.join(open_, "reporter", "left").withColumn("accepted", F.col("_r") + F.coalesce("_open", F.lit(0)) <= most).drop("_r", "_open")


def with_decision(rows: DataFrame, decisions: DataFrame, status: str, oldest_first: bool, limit: int = 200) -> DataFrame:
    """Drafts or reports of one status with their decision's number and chamber."""
    d = decisions.select("doc_id", "decision_no", "category")
    order = F.asc("ts") if oldest_first else F.desc("ts")
    return rows.where(F.col("status") == status).join(d, "doc_id").orderBy(order, "row_id").limit(limit)


def stale_translations(translations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Translations made of another version than the decision now has."""
    return translations.join(decisions.select("doc_id", "version"), "doc_id").where("source_version <> version")


def delivered_only(listing: DataFrame, state: DataFrame) -> DataFrame:
    return listing.join(state.where("status = 'done' and not quarantined").select("doc_id"), "doc_id", "left_semi")


def overlay_records(records: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """Stored records with the current value of each field where it is not empty."""
    now = current.select("doc_id", *[F.col(f).alias(f"_{f}") for f in fields])
    j = records.join(now, "doc_id", "left")
    return j.withColumns({f: F.coalesce(F.nullif(N.text(f"_{f}"), F.lit("")), N.text(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def assemble_delivery(folders: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All folders' records that are done and not held back, and the file names that come twice (must be none)."""
    every = folders[0]
    for f in folders[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    kept = every.where("status = 'done' and not quarantined")
    twice = kept.groupBy("file_name").agg(F.count("*").alias("n")).where("n > 1")
    return kept, twice


def apply_edits(records: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """Records with edited fields; ``edited`` lists those that changed. An edit's null leaves a field as it is."""
    e = edits.select("doc_id", *[F.col(f).alias(f"_{f}") for f in fields])
    j = records.join(e, "doc_id", "left")
    differs = {f: F.col(f"_{f}").isNotNull() & (N.text(f"_{f}") != N.text(f)) for f in fields}
    changed = F.filter(F.array(*[F.when(differs[f], F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return j.withColumn("edited", changed).withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def unmatched_edits(records: DataFrame, edits: DataFrame) -> DataFrame:
    return edits.join(records.select("doc_id"), "doc_id", "left_anti")


def delivery_summary(records: DataFrame, fields: list[str]) -> DataFrame:
    """By chamber, by folder and over all: documents, first and last year, filled fields."""
    sets = records.groupingSets([["chamber"], ["folder"], []], "chamber", "folder")
    filled = [F.count_if(N.text(f) != "").alias(f"has_{f}") for f in fields]
    year = F.nullif(N.text("year"), F.lit(""))
    return sets.agg(F.grouping_id("chamber", "folder").cast("int").alias("level"), F.count("*").alias("n"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), *filled)


def flatten_records(records: DataFrame) -> DataFrame:
    """One flat row per nested record, for spreadsheets. ``fields`` is a map of structs, ``links`` an array of structs."""
    value = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k))["value"], F.lit(""))
    sure = lambda k: F.try_element_at("fields", F.lit(k))["confidence"]
    link = F.transform("links", lambda x: F.concat(x["to"], F.lit("("), x["role"], F.lit(","), x["confidence"], F.lit(")")))
    return records.select(
        "doc_id",
        "level",
        F.coalesce("category.value", F.lit("")).alias("category"),
        F.coalesce("category.source", F.lit("")).alias("category_source"),
        value("decision_no").alias("decision_no"),
        value("file_no").alias("file_no"),
        value("date").alias("date"),
        F.substring(value("date"), -4, 4).alias("year"),
        sure("decision_no").alias("decision_conf"),
        sure("file_no").alias("file_conf"),
        sure("date").alias("date_conf"),
        F.coalesce(F.array_join(link, "؛ "), F.lit("")).alias("links"),
        "status",
    )


# Folders by chamber.
CHAMBER_FOLDERS = {"إدارية": "administrative", "تجارية": "commercial", "مدنية": "civil", "جنائية": "criminal", "اجتماعية": "social", "أحوال شخصية": "personal_status", "عقارية": "real_estate"}
# Courts that a correction may name.
COURTS = ["محكمة النقض", "محكمة الاستئناف", "المحكمة الابتدائية", "المحكمة الدستورية", "المجلس الأعلى للحسابات"]


def chamber_dir(c: Column | str) -> Column:
    """The folder of a chamber, ``undetermined`` where it is unknown."""
    table = F.create_map(*[F.lit(x) for kv in CHAMBER_FOLDERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, N.text(c)), F.lit("undetermined"))


def validate_changes(c: DataFrame, chambers: list[str] = list(CHAMBER_FOLDERS)) -> DataFrame:  # noqa: B006
    """``c`` (doc_id, field, value) with ``error``, empty where the change is allowed."""
    v = N.text("value")
    error = (
        F.when(~F.col("field").isin(EDITABLE), "unknown field")
        .when(F.col("field").isin("decision_no", "file_no", "city", "outcome") & (F.length(v) > 200), "too long")
        .when((F.col("field") == "category") & ~v.isin(*chambers, N.UNKNOWN), "unknown chamber")
        .when((F.col("field") == "court") & ~v.isin(*COURTS), "unknown court")
        .when((F.col("field") == "year") & ~v.rlike("^([0-9]{4})?$"), "use four digits")
        .when((F.col("field") == "decision_date") & ~v.rlike("^([0-9]{2}/[0-9]{2}/[0-9]{4})?$"), "use DD/MM/YYYY")
        .when((F.col("field") == "review") & ~v.isin("ok", "check"), "ok or check")
        .otherwise("")
    )
    return c.withColumn("error", error)


#: Fields that a person may correct.
EDITABLE = ["category", "level", "court", "decision_no", "file_no", "decision_date", "city", "year", "outcome", "review"]


def correct_fields(decisions: DataFrame, changes: DataFrame, fields: list[str] = EDITABLE) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Corrected decisions and an audit row (doc_id, field, old, new) per changed field.

    ``changes``: doc_id, field, value, seq; of several for one field the last counts. A new date sets the
    year, unless that is given too; the sort key follows.
    """
    allowed = changes.where(F.col("field").isin(fields))
    wide = allowed.groupBy("doc_id").pivot("field", fields).agg(F.max_by(F.trim(N.text("value")), "seq"))
    wide = wide.select("doc_id", *[F.col(f).alias(f"_{f}") for f in fields])
    j = decisions.join(wide, "doc_id", "left")
    differs = {f: F.col(f"_{f}").isNotNull() & (F.col(f"_{f}") != N.text(f)) for f in fields}
    log = F.filter(F.array(*[F.when(differs[f], F.struct(F.lit(f).alias("field"), N.text(f).alias("old"), F.col(f"_{f}").alias("new"))) for f in fields]), lambda x: x.isNotNull())
    logged = j.withColumn("_log", log)
    audit = logged.select("doc_id", F.explode("_log").alias("l")).select("doc_id", "l.field", "l.old", "l.new")
    out = logged.withColumn("edited", F.size("_log") > 0)
    if {"year", "decision_date"} <= set(fields):
        out = out.withColumn("_year", F.when(F.col("_year").isNull() & differs["decision_date"] & (F.length("_decision_date") == 10), F.substring("_decision_date", -4, 4)).otherwise(F.col("_year")))
    out = out.withColumns({f: F.coalesce(f"_{f}", f) for f in fields})
    out = out.withColumn("sort_key", F.when(F.col("edited"), N.sort_key("decision_date", "decision_no")).otherwise(F.col("sort_key")))
    return out.drop("_log", *[f"_{f}" for f in fields]), audit


def set_state(decisions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions in their wanted states (doc_id, state), and an audit row for each; unknown states change nothing."""
    ok = wanted.where(F.col("state").isin(STATES)).select("doc_id", F.col("state").alias("_new"))
    j = decisions.join(ok, "doc_id", "left")
    audit = j.where(F.col("_new").isNotNull()).select("doc_id", F.lit("state").alias("field"), F.col("state").alias("old"), F.col("_new").alias("new"))
    return j.withColumn("state", F.coalesce("_new", "state")).drop("_new"), audit


def resolve_reports(reports: DataFrame, decided: DataFrame) -> DataFrame:
    """Reports with their decided status (report_id, status); a decided report's quote is blanked."""
    j = reports.join(decided.select("report_id", F.col("status").alias("_s")), "report_id", "left")
    return j.withColumns({"status": F.coalesce("_s", "status"), "quote": F.when(F.col("_s").isNotNull(), "").otherwise(F.col("quote"))}).drop("_s")


def edits_export(decisions: DataFrame, columns: list[str]) -> DataFrame:
    return decisions.where(F.col("edited_at").isNotNull()).select("doc_id", *columns).orderBy("doc_id")
