"""Imports, upserts, facets, pages, edits and deliveries of the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import extract as X
from docloom.functions import pii as P
from docloom.operators import catalogue as C
from docloom.operators import edits as E
from docloom.operators.components import reliable, shared_dir
from docloom.operators.pages import page
from docloom.plans.registry import query
from docloom.plans.views import pick
from docloom.sources import files, replies

PUBLISHED = "state = 'published'"
_GATE = " OR ".join(f"regexp_matches(text, '{p}')" for p in P.GATE_PATTERNS.values())
_IMPORT = f"""WITH i AS (SELECT r.*, CASE WHEN r.quarantined OR r.status <> 'done' THEN 'held_by_pipeline' WHEN r.k % 41 = 0 THEN 'no_file' WHEN r.error <> '' THEN 'unreadable' WHEN {_GATE.replace('text', 'r.text')} THEN 'gate_quarantined'
  WHEN d.edited_at IS NOT NULL THEN 'kept_edited' WHEN d.doc_id IS NOT NULL THEN 'updated' ELSE 'imported' END AS import_outcome FROM records r LEFT JOIN decisions d USING (doc_id)) """


def _imported(records: DataFrame, decisions: DataFrame) -> DataFrame:
    texts = records.where("k % 41 <> 0").select("doc_id", "text", "error")
    return C.gated_import(records.drop("text", "error"), texts, decisions)


@query("gated_import", ["records", "decisions"], _IMPORT + "SELECT doc_id, import_outcome FROM i")
def _(r: DataFrame, d: DataFrame) -> DataFrame:
    return _imported(r, d).select("doc_id", "import_outcome")


@query("import_counts", ["records", "decisions"], _IMPORT + "SELECT import_outcome, count(*) AS n FROM i GROUP BY import_outcome")
def _(r: DataFrame, d: DataFrame) -> DataFrame:
    return C.import_counts(_imported(r, d))


_NEXT = "CASE WHEN d.state IS NULL OR d.state = 'withdrawn' THEN 'imported' WHEN d.state = 'published' THEN 'under_review' ELSE d.state END"


@query("upsert_decisions", ["decisions", "records"], f"""SELECT coalesce(d.doc_id, r.doc_id) AS doc_id, CASE WHEN t THEN r.category ELSE d.category END AS category, CASE WHEN t THEN r.decision_no ELSE d.decision_no END AS decision_no,
  CASE WHEN t THEN {_NEXT} ELSE d.state END AS state, CASE WHEN t THEN substr(r.decision_date, 7, 4) || substr(r.decision_date, 4, 2) || substr(r.decision_date, 1, 2) || lpad(r.decision_no, 6, '0') ELSE d.sort_key END AS sort_key, d.theme
FROM decisions d FULL JOIN records r ON d.doc_id = r.doc_id, LATERAL (SELECT r.doc_id IS NOT NULL AND (d.doc_id IS NULL OR d.edited_at IS NULL) AS t)""")
def _(d: DataFrame, r: DataFrame) -> DataFrame:
    incoming = r.select("doc_id", "category", "decision_no", "decision_date", F.col("text").alias("body_text"))
    return C.upsert_decisions(d, incoming).select("doc_id", "category", "decision_no", "state", "sort_key", "theme")


@query("enrichment_apply", ["decisions", "records"], """SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN '' WHEN d.edited_at IS NOT NULL THEN 'skipped' WHEN d.category <> r.category OR d.city <> r.city THEN 'changed' ELSE 'same' END AS enriched,
  CASE WHEN r.doc_id IS NOT NULL AND d.edited_at IS NULL THEN r.city ELSE d.city END AS city FROM decisions d LEFT JOIN records r USING (doc_id)""")
def _(d: DataFrame, r: DataFrame) -> DataFrame:
    return C.enrichment_apply(d, r, ["category", "city"]).select("doc_id", "enriched", "city")


@query("enrichment_export", ["decisions"], "SELECT doc_id, theme, rule, abstract FROM decisions WHERE theme <> '' OR abstract <> '' OR rule <> ''")
def _(d: DataFrame) -> DataFrame:
    return C.enrichment_export(d, ["theme", "rule", "abstract"])


_COURT = "CASE WHEN court <> '' THEN court WHEN level = 'استئناف' THEN 'محكمة الاستئناف' WHEN level = 'ابتدائي' THEN 'المحكمة الابتدائية' ELSE 'محكمة النقض' END"


@query("browse_tree", ["decisions"], f"SELECT court, chamber, n, sum(n) OVER (PARTITION BY court)::BIGINT AS court_total FROM (SELECT {_COURT} AS court, category AS chamber, count(*) AS n FROM decisions WHERE {PUBLISHED} GROUP BY 1, 2)")
def _(d: DataFrame) -> DataFrame:
    return C.browse_tree(d)


@query("browse_years", ["decisions"], f"SELECT year, count(*) AS n FROM decisions WHERE {PUBLISHED} AND category = 'مدنية' GROUP BY year")
def _(d: DataFrame) -> DataFrame:
    return C.browse_years(d, "مدنية")


@query("browse_cities", ["decisions"], f"SELECT city, count(*) AS n FROM decisions WHERE {PUBLISHED} AND city <> '' GROUP BY city")
def _(d: DataFrame) -> DataFrame:
    return C.browse_cities(d)


@query("browse_themes", ["decisions"], f"""WITH b AS (SELECT theme_key, theme, count(*) AS n FROM decisions WHERE {PUBLISHED} AND theme_key <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY theme_key ORDER BY n DESC, theme) AS i, sum(n) OVER (PARTITION BY theme_key) AS total FROM b)
SELECT theme_key, theme AS label, total::BIGINT AS n FROM r WHERE i = 1 ORDER BY n DESC, theme_key LIMIT 300""")
def _(d: DataFrame) -> DataFrame:
    return C.browse_themes(d)


@query("platform_counts", ["decisions"], f"SELECT count(*) AS decisions, count(*) FILTER ({PUBLISHED}) AS published, count(*) FILTER (state IN ('imported', 'under_review')) AS pending FROM decisions")
def _(d: DataFrame) -> DataFrame:
    return C.platform_counts(d)


for _name in ("listing_order", "listing_places"):

    @query(_name, ["decisions"], "SELECT doc_id, row_number() OVER (ORDER BY category, year, substr(decision_date, 4, 2), substr(decision_date, 1, 2), coalesce(try_cast(decision_no AS BIGINT), 0), doc_id) AS place FROM decisions")
    def _(d: DataFrame) -> DataFrame:
        """The whole listing, numbered as it is ordered: the rows of the ranges before, and the place within a range."""
        named = d.withColumns({"date_display": F.col("decision_date"), "decision_display": F.col("decision_no")})
        # partition and place within it are one number; both are kept, as ranges may be drawn anew
        rows = reliable(C.listing_order(named).select("doc_id").withColumn("_i", F.monotonically_increasing_id()))
        rows = rows.select("doc_id", F.shiftright("_i", 33).alias("_part"), F.col("_i").bitwiseAND((1 << 33) - 1).alias("_at"))
        sums = rows.groupBy("_part").agg(F.count("*").alias("_n"))
        before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
        return rows.join(F.broadcast(before), "_part").select("doc_id", (F.col("_before") + F.col("_at") + 1).alias("place"))


@query("browse_rulings", ["decisions"], f"SELECT doc_id, (SELECT count(*) FROM decisions WHERE {PUBLISHED} AND category = 'مدنية' AND contains(search_text, 'كراء')) AS total FROM decisions WHERE {PUBLISHED} AND category = 'مدنية' AND contains(search_text, 'كراء') ORDER BY sort_key DESC, doc_id LIMIT 50 OFFSET 10")
def _(d: DataFrame) -> DataFrame:
    return C.browse_rulings(d, chamber="مدنية", match=F.contains("search_text", F.lit("كراء")), offset=10).select("doc_id", "total")


@query("list_decisions", ["decisions"], "SELECT doc_id FROM decisions WHERE state IN ('imported', 'withdrawn') AND level = 'نقض' ORDER BY updated_at DESC, doc_id LIMIT 100 OFFSET 20")
def _(d: DataFrame) -> DataFrame:
    return C.list_decisions(d, ["imported", "withdrawn"], level="نقض", offset=20).select("doc_id")


@query("deep_page", ["decisions"], "SELECT doc_id, sort_key FROM decisions ORDER BY sort_key DESC, doc_id LIMIT 40 OFFSET 700")
def _(d: DataFrame) -> DataFrame:
    """A page that is found by counting ranges."""
    return page(d, [(F.col("sort_key"), False), (F.col("doc_id"), True)], 700, 40, shallow=100).select("doc_id", "sort_key")


@query("work_queue", ["decisions"], "SELECT doc_id, CASE WHEN len(r) = 0 THEN 'needs review' ELSE array_to_string(r, '|') END AS reasons FROM (SELECT doc_id, list_filter([CASE WHEN review = 'check' THEN 'low-confidence link' END, CASE WHEN category IN ('', 'غير محدد') THEN 'missing category' END, CASE WHEN decision_no = '' OR file_no = '' THEN 'missing identifier' END], lambda x: x IS NOT NULL) AS r FROM decisions WHERE state IN ('imported', 'under_review'))")
def _(d: DataFrame) -> DataFrame:
    return C.work_queue(d).select("doc_id", F.array_join("reasons", "|").alias("reasons"))


@query("latest_activity", ["activity"], "SELECT event_id, actor FROM activity QUALIFY row_number() OVER (PARTITION BY actor ORDER BY ts DESC, event_id) <= 5")
def _(a: DataFrame) -> DataFrame:
    return C.latest_activity(a).select("event_id", "actor")


@query("audit_trail", ["activity"], "SELECT event_id, actor, action FROM activity WHERE CAST(actor AS VARCHAR) = '42'")
def _(a: DataFrame) -> DataFrame:
    return C.audit_trail(a.withColumn("entity_id", F.col("actor").cast("string")), "42").select("event_id", "actor", "action")


for _name in ("open_reports_cap", "open_reports_cap_all"):

    @query(_name, ["reports"], "WITH s AS (SELECT *, CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM reports) AS stored FROM reports), o AS (SELECT reporter, count(*) AS n FROM s WHERE status = 'open' AND stored GROUP BY reporter), w AS (SELECT *, row_number() OVER (PARTITION BY reporter ORDER BY ts, report_id) AS i FROM s WHERE NOT stored) SELECT report_id, i + coalesce(n, 0) <= 20 AS accepted FROM w LEFT JOIN o USING (reporter)")
    def _(r: DataFrame) -> DataFrame:
        """The reports of the last day as new ones, and all before them as stored."""
        last = r.agg(F.max(F.to_date("ts")).alias("_last"))
        dated = r.crossJoin(F.broadcast(last))  # one row
        stored, new = dated.where(F.to_date("ts") < F.col("_last")), dated.where(F.to_date("ts") == F.col("_last"))
        return C.open_reports_cap(stored, new, 20).select("report_id", "accepted")


@query("reports_with_decision", ["reports", "decisions"], "SELECT row_id, doc_id, decision_no, category FROM reports JOIN decisions USING (doc_id) WHERE status = 'open' ORDER BY ts DESC, row_id LIMIT 200")
def _(r: DataFrame, d: DataFrame) -> DataFrame:
    return C.with_decision(r.select("row_id", "doc_id", "status", "ts"), d.drop("updated_at", "state"), "open", False).select("row_id", "doc_id", "decision_no", "category")


@query("drafts_with_decision", ["versions", "decisions"], "SELECT row_id, doc_id, decision_no, category FROM versions JOIN decisions USING (doc_id) WHERE status = 'draft' ORDER BY ts, row_id LIMIT 200")
def _(v: DataFrame, d: DataFrame) -> DataFrame:
    return C.with_decision(v, d, "draft", True).select("row_id", "doc_id", "decision_no", "category")


@query("stale_translations", ["decisions", "versions"], "SELECT v.row_id, doc_id FROM versions v JOIN decisions d USING (doc_id) WHERE v.version <> d.version")
def _(d: DataFrame, v: DataFrame) -> DataFrame:
    made = v.select("row_id", "doc_id", F.col("version").alias("source_version"))
    return C.stale_translations(made, d).select("row_id", "doc_id")


@query("delivered_only", ["decisions", "records"], "SELECT doc_id FROM decisions WHERE doc_id IN (SELECT doc_id FROM records WHERE status = 'done' AND NOT quarantined)")
def _(d: DataFrame, r: DataFrame) -> DataFrame:
    return C.delivered_only(d, r).select("doc_id")


@query("overlay_records", ["records", "decisions"], "SELECT r.doc_id, CASE WHEN coalesce(d.city, '') <> '' THEN d.city ELSE r.city END AS city, CASE WHEN coalesce(d.category, '') <> '' THEN d.category ELSE r.category END AS category FROM records r LEFT JOIN decisions d USING (doc_id)")
def _(r: DataFrame, d: DataFrame) -> DataFrame:
    return C.overlay_records(r, d, ["city", "category"]).select("doc_id", "city", "category")


@query("assemble_delivery", ["records"], "SELECT doc_id, file_name, count(*) OVER (PARTITION BY file_name) > 1 AS twice FROM records WHERE status = 'done' AND NOT quarantined")
def _(r: DataFrame) -> DataFrame:
    kept, twice = C.assemble_delivery([r.where("folder = 'a'"), r.where("folder = 'b'").drop("city")])
    return kept.join(twice, "file_name", "left").select("doc_id", "file_name", F.col("n").isNotNull().alias("twice"))


@query("union_folders", ["records"], "SELECT doc_id, folder FROM records")
def _(r: DataFrame) -> DataFrame:
    return r.where("folder = 'a'").unionByName(r.where("folder = 'b'")).select("doc_id", "folder")


_EDITS = "SELECT doc_id, CASE WHEN k % 4 = 0 THEN 'وجدة' END AS city, CASE WHEN k % 6 = 0 THEN category ELSE 'مدنية' END AS category FROM records WHERE k % 5 = 0"


def _edits(r: DataFrame) -> DataFrame:
    return r.where("k % 5 = 0").select("doc_id", F.when(F.col("k") % 4 == 0, "وجدة").alias("city"), F.when(F.col("k") % 6 == 0, F.col("category")).otherwise("مدنية").alias("category"))


@query("apply_edits", ["records"], f"SELECT r.doc_id, coalesce(e.city, r.city) AS city, coalesce(e.category, r.category) AS category, array_to_string(list_filter([CASE WHEN e.city <> r.city THEN 'city' END, CASE WHEN e.category <> r.category THEN 'category' END], lambda x: x IS NOT NULL), '|') AS edited FROM records r LEFT JOIN ({_EDITS}) e USING (doc_id)")
def _(r: DataFrame) -> DataFrame:
    return C.apply_edits(r, _edits(r), ["city", "category"]).select("doc_id", "city", "category", F.array_join("edited", "|").alias("edited"))


@query("unmatched_edits", ["records", "decisions"], f"SELECT doc_id FROM ({_EDITS}) WHERE doc_id NOT IN (SELECT doc_id FROM decisions)")
def _(r: DataFrame, d: DataFrame) -> DataFrame:
    return C.unmatched_edits(d, _edits(r)).select("doc_id")


@query("delivery_summary", ["records"], "SELECT category AS chamber, folder, grouping(category, folder)::INT AS level, count(*) AS n, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (city <> '') AS has_city, count(*) FILTER (decision_no <> '') AS has_decision_no FROM records GROUP BY GROUPING SETS ((category), (folder), ())")
def _(r: DataFrame) -> DataFrame:
    return C.delivery_summary(r.withColumnRenamed("category", "chamber"), ["city", "decision_no"])


@query("flatten_records", ["decisions", "edges"], """SELECT d.doc_id, level, category, 'ruling-text' AS category_source, decision_no, file_no, decision_date AS date, substr(decision_date, 7) AS year, 0.9::DOUBLE AS decision_conf, 0.8::DOUBLE AS file_conf, NULL::DOUBLE AS date_conf, coalesce(links, '') AS links, state AS status
FROM decisions d LEFT JOIN (SELECT parent_doc AS k, string_agg(child_doc || '(reviews,' || confidence || ')', '؛ ' ORDER BY child_doc) AS links FROM edges GROUP BY 1) USING (k)""")
def _(d: DataFrame, e: DataFrame) -> DataFrame:
    links = e.groupBy(F.col("parent_doc").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("child_doc", "confidence"))), lambda x: F.struct(x["child_doc"].cast("string").alias("to"), F.lit("reviews").alias("role"), x["confidence"].alias("confidence"))).alias("links"))
    value = lambda c, p: F.struct(F.col(c).alias("value"), F.lit(p).cast("double").alias("confidence"))
    fields = F.create_map(F.lit("decision_no"), value("decision_no", 0.9), F.lit("file_no"), value("file_no", 0.8), F.lit("date"), value("decision_date", None))
    nested = d.join(links, "k", "left").select("doc_id", "level", F.struct(F.col("category").alias("value"), F.lit("ruling-text").alias("source")).alias("category"), fields.alias("fields"), "links", F.col("state").alias("status"))
    return C.flatten_records(nested)


@query("partition_by_chamber", ["decisions"], "SELECT doc_id, CASE category WHEN 'إدارية' THEN 'administrative' WHEN 'تجارية' THEN 'commercial' WHEN 'مدنية' THEN 'civil' WHEN 'جنائية' THEN 'criminal' WHEN 'اجتماعية' THEN 'social' WHEN 'أحوال شخصية' THEN 'personal_status' WHEN 'عقارية' THEN 'real_estate' ELSE 'undetermined' END AS dir FROM decisions")
def _(d: DataFrame) -> DataFrame:
    return d.select("doc_id", C.chamber_dir("category").alias("dir"))


_CHANGES = f"SELECT doc_id, {pick('k', 'category', 'year', 'decision_date', 'review', 'secret', 'city')} AS field, {pick('k', 'مدنية', '20x1', '31/02/2020', 'check', 'x', 'وجدة', 'nowhere', '2020', '15/03/2021', 'maybe', 'y', 'سلا')} AS value, k AS seq FROM decisions"


def _changes(d: DataFrame) -> DataFrame:
    return d.sparkSession.sql(_CHANGES.replace("FROM decisions", "FROM {d}"), d=d)


@query("validate_changes", ["decisions"], f"SELECT doc_id, field, CASE WHEN field = 'secret' THEN 'unknown field' WHEN field = 'category' AND value <> 'مدنية' THEN 'unknown chamber' WHEN field = 'year' AND NOT regexp_full_match(value, '[0-9]{{4}}') THEN 'use four digits' WHEN field = 'decision_date' AND NOT regexp_full_match(value, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN 'use DD/MM/YYYY' WHEN field = 'review' AND value <> 'check' THEN 'ok or check' ELSE '' END AS error FROM ({_CHANGES})")
def _(d: DataFrame) -> DataFrame:
    return C.validate_changes(_changes(d)).select("doc_id", "field", "error")


@query("correct_fields", ["decisions"], f"SELECT d.doc_id, field, CASE field WHEN 'category' THEN d.category WHEN 'year' THEN d.year WHEN 'decision_date' THEN d.decision_date WHEN 'review' THEN d.review ELSE d.city END AS old, value AS new FROM decisions d JOIN ({_CHANGES}) c USING (doc_id) WHERE field <> 'secret' AND old <> value")
def _(d: DataFrame) -> DataFrame:
    return C.correct_fields(d, _changes(d))[1]


@query("corrected_decisions", ["decisions"], f"SELECT d.doc_id, CASE WHEN field = 'year' THEN value WHEN field = 'decision_date' AND value <> d.decision_date THEN substr(value, 7) ELSE d.year END AS year, CASE WHEN field = 'decision_date' THEN substr(value, 7, 4) || substr(value, 4, 2) || substr(value, 1, 2) || substr(d.sort_key, 9) ELSE d.sort_key END AS sort_key FROM decisions d JOIN ({_CHANGES}) c USING (doc_id)")
def _(d: DataFrame) -> DataFrame:
    return C.correct_fields(d, _changes(d))[0].select("doc_id", "year", "sort_key")


@query("set_state", ["decisions"], "SELECT doc_id, CASE WHEN k % 7 = 0 THEN 'withdrawn' ELSE state END AS state FROM decisions")
def _(d: DataFrame) -> DataFrame:
    wanted = d.where("k % 7 = 0 OR k % 7 = 1").select("doc_id", F.when(F.col("k") % 7 == 0, "withdrawn").otherwise("nonsense").alias("state"))
    return C.set_state(d, wanted)[0].select("doc_id", "state")


@query("resolve_reports", ["reports"], "SELECT report_id, CASE WHEN report_id % 4 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN report_id % 4 = 0 THEN '' ELSE quote END AS quote FROM reports")
def _(r: DataFrame) -> DataFrame:
    decided = r.where("report_id % 4 = 0").select("report_id", F.lit("resolved").alias("status"))
    return C.resolve_reports(r, decided).select("report_id", "status", "quote")


@query("edits_export", ["decisions"], "SELECT doc_id, city, decision_no FROM decisions WHERE edited_at IS NOT NULL")
def _(d: DataFrame) -> DataFrame:
    return C.edits_export(d, ["city", "decision_no"])


_BATCH = """SELECT doc_id, k % 3 AS edit_id, CASE WHEN k % 5 = 0 THEN version + 1 ELSE version END AS base_version, CASE WHEN k % 7 = 0 THEN body_text || ' a@b.com' WHEN k % 2 = 0 THEN replace(body_text, 'قرار', 'XXXXXXX') ELSE body_text || ' x' END AS new_text, 'admin' AS actor, updated_at AS ts FROM decisions"""


def _batch(d: DataFrame) -> DataFrame:
    one = d.sparkSession.sql(_BATCH.replace("FROM decisions", "FROM {d}"), d=d)
    return one.unionByName(one.where("edit_id = 1").withColumn("edit_id", F.lit(9)))


_OUTCOME = "CASE WHEN k % 5 = 0 THEN 'conflict' WHEN k % 7 = 0 THEN 'refused' WHEN k % 2 = 0 THEN 'applied' ELSE 'draft' END"


@query("apply_edit_batch", ["decisions"], f"SELECT doc_id, k % 3 AS edit_id, {_OUTCOME} AS outcome FROM decisions UNION ALL SELECT doc_id, 9, CASE WHEN {_OUTCOME} = 'applied' THEN 'conflict' ELSE {_OUTCOME} END FROM decisions WHERE k % 3 = 1")
def _(d: DataFrame) -> DataFrame:
    return E.apply_edit_batch(d, _batch(d))[2].select("doc_id", "edit_id", "outcome")


@query("edited_decisions", ["decisions"], f"SELECT doc_id, CASE WHEN {_OUTCOME} = 'applied' THEN greatest(version, 1) + 1 ELSE version END AS version FROM decisions")
def _(d: DataFrame) -> DataFrame:
    return E.apply_edit_batch(d, _batch(d))[0].select("doc_id", "version")


@query("restore_version", ["versions", "decisions"], "SELECT w.doc_id, w.version AS restore_of, v.body_text AS new_text, d.version AS base_version FROM (SELECT DISTINCT doc_id, 2 AS version FROM versions) w JOIN versions v ON v.doc_id = w.doc_id AND v.version = 2 AND v.status = 'applied' JOIN decisions d ON d.doc_id = w.doc_id")
def _(v: DataFrame, d: DataFrame) -> DataFrame:
    wanted = v.select("doc_id").distinct().withColumn("version", F.lit(2))
    return E.restore_version(v, wanted, d).select("doc_id", "restore_of", "new_text", "base_version")


@query("discard_draft", ["versions"], "SELECT row_id, CASE WHEN status = 'draft' AND row_id % 2 = 0 THEN 'discarded' ELSE status END AS status, CASE WHEN status = 'draft' AND row_id % 2 = 0 THEN '' ELSE body_text END AS body_text FROM versions")
def _(v: DataFrame) -> DataFrame:
    return E.discard_draft(v, v.where("row_id % 2 = 0").select("row_id")).select("row_id", "status", "body_text")


@query("version_history", ["versions"], "SELECT doc_id, coalesce(string_agg(version::VARCHAR, ',' ORDER BY version DESC) FILTER (status = 'applied'), '') AS versions, count(*) FILTER (status = 'draft') AS drafts FROM versions WHERE status IN ('applied', 'draft') GROUP BY doc_id")
def _(v: DataFrame) -> DataFrame:
    return E.version_history(v).select("doc_id", F.array_join(F.transform("versions", lambda x: x["version"].cast("string")), ",").alias("versions"), F.size("drafts").cast("long").alias("drafts"))


@query("purge_history", ["versions", "decisions"], "SELECT row_id FROM versions v LEFT JOIN (SELECT doc_id, version AS live FROM decisions WHERE k % 2 = 0) d USING (doc_id) WHERE live IS NULL OR NOT (status = 'discarded' OR (status = 'applied' AND v.version < live))")
def _(v: DataFrame, d: DataFrame) -> DataFrame:
    return E.purge_history(v, d, d.where("k % 2 = 0")).select("row_id")


def _path(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


_NESTED = "SELECT doc_id, status, category AS category, leak_passed AS passed, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS links FROM records"


def _nested(r: DataFrame) -> DataFrame:
    link = F.struct(F.lit("x").alias("to"), F.lit("reviews").alias("role"), F.lit("high").alias("confidence"))
    return r.select("doc_id", "status", F.struct(F.col("category").alias("value"), F.lit("text").alias("source")).alias("category"), F.struct(F.col("leak_passed").alias("passed"), F.lit(0).alias("hits")).alias("leak_test"), F.when(F.col("k") % 2 == 0, F.array(link)).otherwise(F.array().cast("array<struct<to:string,role:string,confidence:string>>")).alias("links"))


@query("write_records", ["records"], _NESTED)
def _(r: DataFrame) -> DataFrame:
    """Nested records written as JSON and read back with the schema of records."""
    path = _path(r, "records")
    files.write_records(_nested(r), path)
    back = r.sparkSession.read.schema(files.RECORD).json(path)
    return back.select("doc_id", "status", "category.value", "leak_test.passed", F.size("links").alias("links")).withColumnRenamed("value", "category")


@query("load_records", ["records"], _NESTED)
def _(r: DataFrame) -> DataFrame:
    """Records as JSON arrays, one file for each part."""
    path = _path(r, "arrays")
    one = _nested(r).select(F.to_json(F.struct("*")).alias("j"), F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part"))
    one.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = files.load_records(r.sparkSession, path)
    return back.select("doc_id", "status", F.col("category.value").alias("category"), "leak_test.passed", F.size("links").alias("links"))


@query("csv_exports", ["decisions"], "SELECT doc_id, city, theme FROM decisions")
def _(d: DataFrame) -> DataFrame:
    path = _path(d, "csv")
    files.write_csv(d.select("doc_id", "city", "theme"), path)
    return d.sparkSession.read.option("header", True).csv(path).fillna("")


@query("load_truth", ["records"], "SELECT doc_id, format, category AS chamber, decision_no AS number FROM records")
def _(r: DataFrame) -> DataFrame:
    """Truth as JSON objects keyed by document, one for each part."""
    path = _path(r, "truth")
    entry = F.struct("format", F.col("category").alias("chamber"), F.create_map(F.lit("number"), F.col("decision_no")).alias("fields"))
    r.select("doc_id", entry.alias("e"), F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("p")).groupBy("p").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("doc_id", "e")))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.load_truth(r.sparkSession, path).select("doc_id", "format", "chamber", F.try_element_at("fields", F.lit("number")).alias("number"))


@query("load_edits", ["records"], f"SELECT doc_id, city, category FROM ({_EDITS})")
def _(r: DataFrame) -> DataFrame:
    path = _path(r, "edits")
    one = _edits(r).select(F.to_json(F.struct("*")).alias("j"), F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part"))
    one.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.load_edits(r.sparkSession, path, ["city", "category"])


@query("table_store", ["decisions"], "SELECT doc_id, state, '' AS later FROM decisions WHERE k % 2 = 0")
def _(d: DataFrame) -> DataFrame:
    """Two snapshots of a table, of which readers see the newest; a column added later is filled in."""
    path = _path(d, "store")
    files.write_snapshot(d.select("doc_id", "state"), path, 1)
    newest = files.write_snapshot(d.where("k % 2 = 0").select("doc_id", "state"), path, 2)
    return files.read_table(d.sparkSession, newest, {"later": "string"})


@query("clean_reply_rows", ["records"], "SELECT doc_id, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS findings, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS refs, '' AS court FROM records")
def _(r: DataFrame) -> DataFrame:
    text = F.when(F.col("k") % 2 == 0, F.lit('"a"')).otherwise("null")
    number = F.when(F.col("k") % 3 == 0, F.lit("null")).otherwise('"1/2"')
    reply = F.concat(F.lit('{"pages":["p"],"court":null,"pii":[{"text":'), text, F.lit(',"type":"n"}],"refs":[{"court":"c","file_no":'), number, F.lit("}]}"))
    got = replies.read_replies(r.select("doc_id", reply.alias("reply")), ["doc_id"]).withColumn("c", replies.clean_reply_rows(F.col("result")))
    return got.select("doc_id", F.size("c.pii").alias("findings"), F.size("c.refs").alias("refs"), "c.court")


@query("headnote_fields", ["decisions"], "SELECT doc_id, theme, theme_key, CASE WHEN theme = '' THEN '' ELSE theme || ' - شروطه - أثره' END AS keywords, CASE WHEN theme = '' THEN '' ELSE rule END AS rule, CASE WHEN theme = '' THEN '' ELSE 'court' END AS theme_source FROM decisions")
def _(d: DataFrame) -> DataFrame:
    note = F.when(F.col("theme") != "", F.struct("theme", F.array(F.lit("شروطه")).alias("sub"), F.lit("أثره").alias("qualifier"), "rule"))
    return d.select("doc_id", X.headnote_fields(note).alias("h")).select("doc_id", "h.*")


@query("refresh_listing", ["rulings"], "SELECT count(*) AS documents, count(*) FILTER (contains(text, 'ملف مدني') OR contains(text, 'ملف شرعي') OR contains(text, 'ملف تجاري') OR contains(text, 'ملف جنحي')) AS with_chamber, count(*) AS with_date, count(*) AS with_number FROM rulings")
def _(r: DataFrame) -> DataFrame:
    """Chamber, date and number of all delivered texts read again, and how many have each."""
    again = r.select(X.chamber_from_text("text").alias("chamber"), X.extract_identity("text").alias("i"))
    return again.agg(F.count("*").alias("documents"), F.count_if(F.col("chamber") != "").alias("with_chamber"), F.count_if(X.display_date("i.date") != "").alias("with_date"), F.count_if(X.display_decision_no("i.decision_no") != "").alias("with_number"))


@query("union_refs", ["case_refs"], "SELECT doc_id, ref_ix FROM case_refs UNION ALL SELECT doc_id, ref_ix + 100 FROM case_refs")
def _(refs: DataFrame) -> DataFrame:
    return refs.unionByName(refs.withColumn("ref_ix", F.col("ref_ix") + 100)).select("doc_id", "ref_ix")


@query("union_records", ["records", "decisions"], "SELECT doc_id, city, CASE WHEN true THEN folder END AS folder FROM records UNION ALL SELECT doc_id, city, NULL FROM decisions")
def _(r: DataFrame, d: DataFrame) -> DataFrame:
    return r.select("doc_id", "city", "folder").unionByName(d.select("doc_id", "city"), allowMissingColumns=True)


_LAST = "SELECT doc_id, k, string_split(s, ' ')[1] AS w, substr(s, 1 + length(string_split(s, ' ')[1])) AS rest FROM (SELECT doc_id, k, split_part(body_text, chr(10), 3) AS s FROM decisions)"


@query("edit_diff", ["decisions"], f"""SELECT doc_id, '[{{"line":1,"segments":[{{"op":"del","text":"قرار"}},{{"op":"ins","text":"XXXXXXX"}},{{"op":"equal","text":" رقم ' || k || '"}}]}},{{"line":3,"segments":[{{"op":"del","text":"' || w || '"}},{{"op":"ins","text":"x' || w || '"}}'
  || CASE WHEN rest <> '' THEN ',{{"op":"equal","text":"' || rest || '"}}' ELSE '' END || ']}}]' AS hunks FROM ({_LAST})""")
def _(d: DataFrame) -> DataFrame:
    """A word hidden in the first line, and a letter added in the third."""
    new = F.regexp_replace(F.replace("body_text", F.lit("قرار"), F.lit(P.TOKEN)), r"\n([^\n]*)$", "\nx$1")
    return d.select("doc_id", F.to_json(E.edit_diff("body_text", new)).alias("hunks"))
