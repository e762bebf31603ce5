"""Linking rulings, their cases, and the subjects they are filed under."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import extract as X
from docloom.functions import normalise as N
from docloom.operators import linkage as L
from docloom.operators import relinking as I
from docloom.operators import subjects as S
from docloom.operators.components import stored
from docloom.plans.registry import query
from docloom.plans.scalar_queries import AS_OF, CANON_DATE, CANON_FILE, STRIP, by_headnote, g, squeeze, sub

_FILE = CANON_FILE.replace("regexp_replace(f,", "regexp_replace(file_no,")
_DATE = CANON_DATE.replace("translate(d,", "translate(date,")
_LEVEL = "CASE WHEN contains({c}, 'النقض') OR contains({c}, 'المجلس الاعلي') THEN 'نقض' WHEN contains({c}, 'الاستئناف') OR contains({c}, 'الاستناف') THEN 'استئناف' WHEN contains({c}, 'الابتدائية') OR contains({c}, 'الادارية') OR contains({c}, 'التجارية') THEN 'ابتدائي' ELSE '' END".replace("{c}", STRIP.replace("{}", "court"))
_PARTS = "list_sort(list_distinct(regexp_extract_all(file_no, '[0-9]+')))"
_FACTS = f"{_FILE} AS fn, {_DATE} AS dn, trim(decision_no) AS dec, {_PARTS} AS parts, city, {_LEVEL} AS lv"

_CANDIDATES = f"""WITH d AS (SELECT doc_id AS child, {_FACTS} FROM case_docs), r AS (SELECT doc_id, ref_ix, {_FACTS} FROM case_refs),
c AS (SELECT r.doc_id, r.ref_ix, d.child, r.fn <> '' AND r.fn = d.fn AS file, r.fn <> '' AND d.fn <> '' AND r.fn <> d.fn AND r.parts = d.parts AS fuzzy,
  r.dec <> '' AND r.dec = d.dec AS dec, r.dn <> '' AND r.dn = d.dn AS date, (r.city <> '' AND r.city = d.city) OR (r.lv <> '' AND r.lv = d.lv) AS court
  FROM r JOIN d ON (r.fn <> '' AND r.fn = d.fn) WHERE r.doc_id <> d.child
  UNION SELECT r.doc_id, r.ref_ix, d.child, r.fn <> '' AND r.fn = d.fn, r.fn <> '' AND d.fn <> '' AND r.fn <> d.fn AND r.parts = d.parts,
  true, true, (r.city <> '' AND r.city = d.city) OR (r.lv <> '' AND r.lv = d.lv)
  FROM r JOIN d ON r.dec = d.dec AND r.dn = d.dn WHERE r.dec <> '' AND r.dn <> '' AND r.doc_id <> d.child),
s AS (SELECT *, CASE WHEN file THEN 3 WHEN fuzzy THEN 1 ELSE 0 END + CASE WHEN dec THEN 2 ELSE 0 END + CASE WHEN date THEN 1 ELSE 0 END + CASE WHEN court THEN 1 ELSE 0 END AS score,
  CASE WHEN file AND (dec OR date) AND court THEN 'high' WHEN file OR (dec AND date AND court) THEN 'medium' ELSE 'low' END AS confidence FROM c),
lr AS (SELECT doc_id, CASE level WHEN 'ابتدائي' THEN 1 WHEN 'استئناف' THEN 2 WHEN 'نقض' THEN 3 ELSE 0 END AS l FROM case_docs),
k AS (SELECT s.* FROM s JOIN lr p USING (doc_id) JOIN lr q ON q.doc_id = s.child WHERE p.l = 0 OR q.l = 0 OR p.l > q.l),
b AS (SELECT doc_id, ref_ix, arg_min(child, (-score) * 1e12 + child) AS child_doc, max(score) AS score, arg_min(confidence, (-score) * 1e12 + child) AS confidence FROM k WHERE confidence IN ('high', 'medium') GROUP BY doc_id, ref_ix)
"""


@query("link_candidates", ["case_docs", "case_refs"], _CANDIDATES + "SELECT doc_id, ref_ix, child FROM c")
def _(docs: DataFrame, refs: DataFrame) -> DataFrame:
    return L.link_candidates(docs, refs, AS_OF).select("doc_id", "ref_ix", "child")


@query("match_score", ["case_docs", "case_refs"], _CANDIDATES + "SELECT doc_id, ref_ix, child, score, confidence FROM s")
def _(docs: DataFrame, refs: DataFrame) -> DataFrame:
    return L.match_score(L.link_candidates(docs, refs, AS_OF)).select("doc_id", "ref_ix", "child", "score", "confidence")


@query("rank_filter", ["case_docs", "case_refs"], _CANDIDATES + "SELECT doc_id, ref_ix, child FROM k")
def _(docs: DataFrame, refs: DataFrame) -> DataFrame:
    return L.ranked_candidates(docs, refs, AS_OF).select("doc_id", "ref_ix", "child")


@query("best_link", ["case_docs", "case_refs"], _CANDIDATES + "SELECT doc_id AS parent_doc, child_doc, confidence, score FROM b")
def _(docs: DataFrame, refs: DataFrame) -> DataFrame:
    return L.relink(docs, refs, AS_OF)


_CASES = f""", up AS (SELECT parent_doc AS a, child_doc AS b FROM edges UNION SELECT child_doc, parent_doc FROM edges),
reach AS (SELECT doc_id AS node, doc_id AS root FROM case_docs UNION SELECT up.b, reach.root FROM reach JOIN up ON up.a = reach.node),
comp AS (SELECT node AS doc_id, min(root) AS component FROM reach GROUP BY node),
m AS (SELECT d.doc_id, component, CASE level WHEN 'ابتدائي' THEN 1 WHEN 'استئناف' THEN 2 WHEN 'نقض' THEN 3 ELSE 9 END AS r, {_FILE} AS no FROM case_docs d JOIN comp USING (doc_id)),
w AS (SELECT DISTINCT component FROM comp JOIN edges ON doc_id = parent_doc WHERE confidence IN ('low', 'medium')),
n AS (SELECT component, arg_min(CASE WHEN no <> '' THEN no ELSE doc_id::VARCHAR END, r * 1e15 + doc_id) AS name FROM m GROUP BY component),
cases AS (SELECT doc_id, 'C:' || name AS case_id, CASE WHEN component IN (SELECT component FROM w) THEN 'check' ELSE 'ok' END AS review FROM m JOIN n USING (component))
"""
#: The views of cases; recursion must come first in DuckDB's WITH.
_RECURSIVE = "WITH RECURSIVE dummy AS (SELECT 1)" + _CASES


def _recursive(sql: str) -> str:
    return sql.replace("WITH case_docs AS", "WITH RECURSIVE case_docs AS", 1)


@query("connected_cases", ["case_docs", "edges"], "WITH dummy AS (SELECT 1)" + _CASES + "SELECT doc_id, case_id, review FROM cases")
def _(docs: DataFrame, edges: DataFrame) -> DataFrame:
    return L.connected_cases(docs, edges, AS_OF)


_LIVE = "live AS (SELECT * FROM case_docs WHERE doc_id % 11 <> 3), "
_RELINKED = (_CANDIDATES.replace("WITH d AS", "WITH " + _LIVE + "d AS").replace("FROM case_docs", "FROM live", 2).replace("FROM live WHERE doc_id % 11", "FROM case_docs WHERE doc_id % 11").replace("FROM case_refs", "FROM case_refs WHERE doc_id % 11 <> 3").replace("FROM case_docs)", "FROM live)")
  + ", edges AS (SELECT doc_id AS parent_doc, child_doc, confidence FROM b)" + _CASES.replace("case_docs", "live") + "SELECT doc_id, case_id, review FROM cases")


@query("incremental_relink", ["case_docs", "case_refs"], _RELINKED)
def _(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """All documents in two batches, of which the second replaces some and removes others: the cases of one full run."""
    wrong = docs.where("doc_id % 7 = 2 AND doc_id % 2 = 0").withColumns({"file_no": F.lit("1/2/2003"), "level": F.lit("")})
    first = docs.where("doc_id % 2 = 0 AND doc_id % 7 <> 2").unionByName(wrong)
    second = docs.where("doc_id % 11 <> 3 AND (doc_id % 2 = 1 OR doc_id % 7 = 2)")
    state = I.apply_batch(I.empty_state(docs, refs), first, refs, docs.select("doc_id").limit(0), AS_OF)
    state["cases"] = stored(state["cases"])  # the others are stored tables already
    state = I.apply_batch(state, second, refs, docs.where("doc_id % 11 = 3").select("doc_id"), AS_OF)
    return state["cases"].select("doc_id", "case_id", "review")


def _with_cases(docs: DataFrame, edges: DataFrame) -> DataFrame:
    return docs.join(L.connected_cases(docs, edges, AS_OF), "doc_id")


_SUMMARY = f"""WITH dummy AS (SELECT 1){_CASES}, j AS (SELECT d.*, case_id, review FROM case_docs d JOIN cases USING (doc_id)),
cited AS (SELECT case_id, list(DISTINCT {_LEVEL}) AS l FROM (SELECT r.court, case_id FROM case_refs r JOIN cases USING (doc_id)) GROUP BY case_id),
s AS (SELECT case_id, coalesce(arg_min(category, doc_id) FILTER (category <> ''), '') AS category, coalesce(bool_or(level = 'ابتدائي'), false) AS h1, coalesce(bool_or(level = 'استئناف'), false) AS h2, coalesce(bool_or(level = 'نقض'), false) AS h3,
  arg_max(CASE WHEN court <> '' THEN court ELSE level END, doc_id) FILTER (level = 'ابتدائي') AS c1, arg_max(CASE WHEN court <> '' THEN court ELSE level END, doc_id) FILTER (level = 'استئناف') AS c2, arg_max(CASE WHEN court <> '' THEN court ELSE level END, doc_id) FILTER (level = 'نقض') AS c3,
  arg_max(file_no, doc_id) FILTER (level = 'ابتدائي') AS f1, arg_max(file_no, doc_id) FILTER (level = 'استئناف') AS f2, arg_max(file_no, doc_id) FILTER (level = 'نقض') AS f3,
  array_to_string(list_sort(list(doc_id::VARCHAR)), '؛ ') AS docs, arg_min(review, doc_id) AS review FROM j GROUP BY case_id),
t AS (SELECT s.*, coalesce(l, []) AS l FROM s LEFT JOIN cited USING (case_id)),
k AS (SELECT *, h3 OR list_contains(l, 'نقض') AS k3, h2 OR h3 OR list_contains(l, 'استئناف') AS k2, h1 OR h2 OR h3 OR list_contains(l, 'ابتدائي') AS k1 FROM t)
SELECT case_id, category, array_to_string(list_filter([CASE WHEN h1 THEN 'ابتدائي' END, CASE WHEN h2 THEN 'استئناف' END, CASE WHEN h3 THEN 'نقض' END], lambda x: x IS NOT NULL), '، ') AS levels_present,
  array_to_string(list_filter([CASE WHEN h1 THEN c1 END, CASE WHEN h2 THEN c2 END, CASE WHEN h3 THEN c3 END], lambda x: x IS NOT NULL), ' → ') AS courts_passed,
  coalesce(f1, '') AS ibtidai_file, coalesce(f2, '') AS istinaf_file, coalesce(f3, '') AS naqd_file, CASE WHEN k2 THEN 'نعم' ELSE 'لا' END AS appealed, CASE WHEN k3 THEN 'نعم' ELSE 'لا' END AS cassated,
  array_to_string(list_filter([CASE WHEN k1 AND NOT h1 THEN 'ابتدائي' END, CASE WHEN k2 AND NOT h2 THEN 'استئناف' END, CASE WHEN k3 AND NOT h3 THEN 'نقض' END], lambda x: x IS NOT NULL), '، ') AS missing_levels, docs, review FROM k"""


@query("case_summary", ["case_docs", "case_refs", "edges"], _SUMMARY)
def _(docs: DataFrame, refs: DataFrame, edges: DataFrame) -> DataFrame:
    return L.case_summary(_with_cases(docs, edges), refs)


@query("case_corpus_filter", ["case_docs", "edges"], f"WITH dummy AS (SELECT 1){_CASES} SELECT doc_id, case_id FROM cases WHERE case_id IN (SELECT case_id FROM cases JOIN case_docs USING (doc_id) WHERE corpus = 'north')")
def _(docs: DataFrame, edges: DataFrame) -> DataFrame:
    return L.case_corpus_filter(_with_cases(docs, edges), "north").select("doc_id", "case_id")


_LINKS = "SELECT parent_doc AS doc_id, child_doc AS \"to\", 'reviews' AS role, confidence FROM edges UNION ALL SELECT child_doc, parent_doc, 'reviewed_by', confidence FROM edges"


@query("links_for", ["edges"], _LINKS)
def _(edges: DataFrame) -> DataFrame:
    return L.links_for(edges)


@query("visible_links", ["edges", "decisions"], f"SELECT l.* FROM ({_LINKS}) l WHERE \"to\" IN (SELECT k FROM decisions WHERE state = 'published')")
def _(edges: DataFrame, d: DataFrame) -> DataFrame:
    return L.visible_links(L.links_for(edges), d.select(F.col("k").alias("doc_id"), "state")).select("doc_id", "to", "role", "confidence")


@query("replace_links", ["edges", "records"], """WITH t AS (SELECT k AS doc_id FROM records WHERE k % 6 <> 0 AND k % 10 = 3)
SELECT parent_doc, child_doc, confidence FROM edges WHERE parent_doc NOT IN (SELECT doc_id FROM t) AND child_doc NOT IN (SELECT doc_id FROM t) UNION ALL SELECT doc_id, doc_id - 1, 'high' FROM t""")
def _(edges: DataFrame, records: DataFrame) -> DataFrame:
    again = records.where("k % 6 <> 0 AND k % 10 = 3").select(F.col("k").alias("doc_id"))
    new = again.select("doc_id", (F.col("doc_id") - 1).alias("to"), F.lit("reviews").alias("role"), F.lit("high").alias("confidence"))
    return L.replace_links(edges, new, again)


_ORIGIN = """WITH r AS (SELECT doc_id, ref_ix, CASE WHEN contains(court, 'الاستئناف') THEN 1 WHEN contains(court, 'الابتدائية') THEN 2 ELSE 3 END AS rank,
  CASE WHEN city <> '' THEN city WHEN contains(court, 'فاس') THEN 'فاس' ELSE '' END AS city FROM case_refs WHERE NOT contains(court, 'النقض')),
b AS (SELECT doc_id, arg_min(city, rank * 100 + ref_ix) AS city, min(rank) AS rank FROM r WHERE city <> '' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN b.city IS NOT NULL THEN b.city WHEN contains(d.court, 'الاستئناف') THEN 'فاس' ELSE '' END AS origin_city,
  CASE WHEN b.city IS NOT NULL THEN ['appeal', 'first-instance', 'reference'][b.rank] WHEN contains(d.court, 'الاستئناف') THEN 'appeal-in-text' ELSE '' END AS origin_city_source FROM case_docs d LEFT JOIN b USING (doc_id)"""


@query("origin_city", ["case_docs", "case_refs"], _ORIGIN)
def _(docs: DataFrame, refs: DataFrame) -> DataFrame:
    return X.origin_city(refs, docs.withColumn("text", F.concat(F.lit("قضت "), "court", F.lit(" بما يلي"))))


_LOOSE = squeeze(g(sub(g("{}", N.HEADNOTE_MARKS), "أإآٱ", "اااا"), r"(^|[^\p{L}\p{N}_])ال([^\s][^\s][^\s])", r"\1\2"))
_VOCAB = f"""WITH v AS (SELECT {_LOOSE.replace('{}', 'theme')} AS key, theme, count(*) AS n FROM decisions WHERE theme_source = 'court' GROUP BY ALL HAVING key <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, theme) AS i, sum(n) OVER (PARTITION BY key) AS total FROM v),
vocab AS (SELECT key, theme AS label, total::BIGINT AS n FROM r WHERE i = 1) """
_PROP = f"SELECT p.doc_id, chamber, proposed, {_LOOSE.replace('{}', 'proposed')} AS key FROM proposals p"


@query("theme_vocabulary", ["decisions"], _VOCAB + "SELECT key, label, n FROM vocab")
def _(d: DataFrame) -> DataFrame:
    return S.theme_vocabulary(d)


_CHAMBER = """WITH b AS (SELECT category, theme_key, theme, count(*) AS n FROM decisions WHERE state = 'published' AND theme_key <> '' GROUP BY ALL),
l AS (SELECT category, theme_key, arg_max(theme, n * 1000 - row_n) AS label, sum(n)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY category, theme_key ORDER BY theme) AS row_n FROM b) GROUP BY ALL),
cv AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, theme_key) <= 60) """


@query("chamber_vocabulary", ["decisions"], _CHAMBER + "SELECT category, theme_key, label, n FROM cv")
def _(d: DataFrame) -> DataFrame:
    return S.chamber_vocabulary(d)


_TKEY = squeeze("regexp_replace(" + sub(g("theme", N.HEADNOTE_MARKS), "أإآٱ", "اااا") + ", '^ال([^\\s][^\\s][^\\s])', '\\1')")


@query("accept_theme", ["decisions"], _CHAMBER + f", a AS (SELECT doc_id, category AS chamber, theme, {_TKEY} AS theme_key FROM decisions WHERE theme <> '') SELECT a.doc_id, a.chamber, a.theme, a.theme_key, label FROM a LEFT JOIN cv ON cv.category = a.chamber AND cv.theme_key = a.theme_key")
def _(d: DataFrame) -> DataFrame:
    answers = d.where("theme <> ''").select("doc_id", F.col("category").alias("chamber"), "theme")
    return S.accept_theme(answers, S.chamber_vocabulary(d)).select("doc_id", "chamber", "theme", "theme_key", "label")


@query("reconcile_proposals", ["decisions", "proposals"], _VOCAB + f", p AS ({_PROP}) SELECT p.doc_id, proposed, p.key, label AS existing FROM p LEFT JOIN vocab ON vocab.key = p.key")
def _(d: DataFrame, p: DataFrame) -> DataFrame:
    return S.reconcile_proposals(p, S.theme_vocabulary(d)).select("doc_id", "proposed", "key", "existing")


@query("folded_in_counts", ["decisions", "proposals"], _VOCAB + f", p AS ({_PROP}) SELECT proposed, label AS existing, count(*) AS n FROM p JOIN vocab ON vocab.key = p.key GROUP BY ALL ORDER BY n DESC, proposed LIMIT 12")
def _(d: DataFrame, p: DataFrame) -> DataFrame:
    return S.folded_in_counts(S.reconcile_proposals(p, S.theme_vocabulary(d)))


_REVIEW = f"""WITH p AS ({_PROP}), s AS (SELECT key, proposed, count(*) AS n FROM p GROUP BY ALL),
g AS (SELECT key, list(proposed ORDER BY n DESC, proposed) AS sp, sum(n)::BIGINT AS rulings FROM s GROUP BY key) """


@query("proposal_review", ["proposals"], _REVIEW + ", c AS (SELECT key, string_agg(chamber || '=' || n, ',' ORDER BY chamber) AS chambers FROM (SELECT key, chamber, count(*) AS n FROM p GROUP BY ALL) GROUP BY key) SELECT key, sp[1] AS label, rulings, chambers, array_to_string(sp[2:], '|') AS also_spelled FROM g JOIN c USING (key)")
def _(p: DataFrame) -> DataFrame:
    r = S.proposal_review(p)
    entries = F.transform(F.array_sort(F.map_entries("chambers")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return r.select("key", "label", "rulings", F.array_join(entries, ",").alias("chambers"), F.array_join("also_spelled", "|").alias("also_spelled"))


@query("apply_approvals", ["proposals"], _REVIEW + ", a AS (SELECT key, sp[1] AS label, CASE rulings % 3 WHEN 0 THEN true WHEN 1 THEN false END AS approve FROM g) SELECT doc_id, CASE WHEN approve THEN label END AS label, approve IS NULL AS undecided FROM p JOIN a USING (key) WHERE approve OR approve IS NULL")
def _(p: DataFrame) -> DataFrame:
    approve = F.when(F.col("rulings") % 3 == 0, True).when(F.col("rulings") % 3 == 1, False)
    filed, left = S.apply_approvals(p, S.proposal_review(p).withColumn("approve", approve))
    return filed.withColumn("undecided", F.lit(False)).unionByName(left.select("doc_id", F.lit(None).cast("string").alias("label"), F.lit(True).alias("undecided")))


@query("classify_todo", ["decisions"], "SELECT doc_id FROM decisions WHERE state = 'published' AND theme = '' AND abstract = '' AND length(body_text) > 30")
def _(d: DataFrame) -> DataFrame:
    return S.classify_todo(d, 30)


@query("derive_coverage", ["decisions"], "SELECT count(*) AS rows, round(100 * count(*) FILTER (theme <> '') / count(*), 1) AS with_subject, round(100 * count(*) FILTER (rule <> '') / count(*), 1) AS with_rule, round(100 * count(*) FILTER (outcome <> '') / count(*), 1) AS with_outcome FROM decisions")
def _(d: DataFrame) -> DataFrame:
    return S.derive_coverage(d)


_READ = f"SELECT *, {by_headnote(1, 'k')} AS t, {by_headnote(3, 'k')} AS r FROM decisions"


@query("derive_from_stored", ["decisions"], f"SELECT doc_id, CASE WHEN t = '' AND theme_source = 'model' THEN theme ELSE t END AS theme, CASE WHEN t <> '' THEN 'court' WHEN theme_source = 'model' THEN 'model' ELSE '' END AS theme_source, r AS rule, CASE WHEN k % 3 = 0 THEN 'رفض الطلب' ELSE '' END AS outcome FROM ({_READ})")
def _(d: DataFrame) -> DataFrame:
    """Texts with headnotes of several kinds, some with an outcome as a heading."""
    heading = F.when(F.col("k") % 3 == 0, "\nرفض الطلب\n").otherwise("\n")
    return S.derive_from_stored(d.withColumn("body_text", F.concat(F.expr(by_headnote(0, "k")), heading, "body_text"))).select("doc_id", "theme", "theme_source", "rule", "outcome")
