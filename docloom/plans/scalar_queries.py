"""Normalisers, keys and extraction over noisy strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import extract as X
from docloom.functions import normalise as N
from docloom.functions import pii as P
from docloom.functions import quality as Q
from docloom.plans.registry import query

AS_OF = 2026


def g(x: str, pattern: str, to: str = "") -> str:
    """regexp_replace over all matches in DuckDB."""
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def sub(x: str, a: str, b: str) -> str:
    return f"translate({x}, '{a}', '{b}')"


def squeeze(x: str) -> str:
    return f"trim({g(x, chr(92) + 's+', ' ')})"


MARKS, WIDE, HEAD = N.MARKS, N.MARKS_AND_DIGITS, N.HEADNOTE_MARKS
DIGITS = (N.ARABIC_DIGITS, N.DIGITS)

SEARCH = squeeze(f"lower({sub(g(sub('{}', *DIGITS), WIDE), 'أإآٱىة', 'اااايه')})")
FIELD = squeeze(sub(sub(g("{}", MARKS), N.ARABIC_DIGITS + N.PERSIAN_DIGITS + N.LOOKALIKES[0], N.DIGITS * 2 + N.LOOKALIKES[1]), "أإآٱى", "ااااي"))
CATEGORY = squeeze(sub(g("{}", WIDE), "أإآى", "اااي"))
STRIP = sub(g("{}", MARKS), "أإآى", "اااي")
KINDS = {"norm_search": (N.norm_search, SEARCH), "norm_field": (N.norm_field, FIELD), "norm_category": (N.norm_category, CATEGORY)}
KINDS["norm_eval"] = (N.norm_eval, g(sub(g(sub("{}", *DIGITS), WIDE), "أإآى", "اااي"), r"\s+"))
KINDS["collapse_leak"] = (N.collapse_leak, g(sub(g("{}", MARKS), "أإآٱى", "ااااي"), r"\s+"))
KINDS["strip_diac"] = (N.strip_diac, STRIP)
_THEME = sub(g("{}", HEAD), "أإآٱ", "اااا")
KINDS["theme_key"] = (N.theme_key, squeeze(f"regexp_replace({_THEME}, '^ال([^\\s][^\\s][^\\s])', '\\1')"))
KINDS["loose_key"] = (N.loose_key, squeeze(g(_THEME, r"(^|[^\p{L}\p{N}_])ال([^\s][^\s][^\s])", r"\1\2")))
KINDS["norm_court"] = (N.norm_court, squeeze(sub(STRIP, "ب", " ")))
KINDS["xml_safe"] = (N.xml_safe, g("{}", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))


def scalar(name: str, fn: Callable[[str], Column], sql: str, column: str) -> None:
    @query(name, ["raw"], f"SELECT doc_id, {sql} AS value FROM raw")
    def _(raw: DataFrame) -> DataFrame:
        return raw.select("doc_id", fn(column).alias("value"))


for _name, (_fn, _sql) in KINDS.items():
    scalar(_name, _fn, _sql.replace("{}", "s"), "s")

_FILE0 = "trim(regexp_replace(regexp_replace(f, '[^\\d/\\-\\s]', '', 'g'), '^\\s+|\\s+$', '', 'g'))"
_FILE1 = "regexp_replace(regexp_replace(regexp_replace(" + _FILE0 + ", '[\\-\\s]+', '/', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g')"
CANON_FILE = f"""(SELECT CASE WHEN len(p) >= 3 AND regexp_full_match(p[-1], '[0-9]{{2}}') AND len(list_filter(p, lambda x: regexp_full_match(x, '(19|20)[0-9]{{2}}'))) = 0
  THEN array_to_string(p[:-2], '/') || '/' || CASE WHEN p[-1]::INT <= {AS_OF % 100} THEN '20' ELSE '19' END || p[-1] ELSE array_to_string(p, '/') END FROM (SELECT string_split({_FILE1}, '/') AS p))"""
scalar("canon_file_no", lambda c: N.canon_file_no(c, AS_OF), CANON_FILE, "f")
scalar("file_components", lambda c: F.array_join(N.file_components(c), ","), "array_to_string(list_sort(list_distinct(regexp_extract_all(f, '[0-9]+'))), ',')", "f")
CANON_DATE = """(SELECT CASE WHEN len(r) >= 3 AND y IS NOT NULL THEN y || '|' || CASE len(o) WHEN 0 THEN '|' WHEN 1 THEN '|' || o[1] ELSE array_to_string(list_sort(o), '|') END ELSE '' END
  FROM (SELECT r, y, list_filter(r, lambda x: x <> y)[:2] AS o FROM (SELECT r, list_filter(r, lambda x: length(x) = 4)[1] AS y FROM (SELECT regexp_extract_all(translate(d, '٠١٢٣٤٥٦٧٨٩', '٠١٢٣٤٥٦٧٨٩'), '[0-9٠-٩]+') AS r))))"""
scalar("canon_date", N.canon_date, CANON_DATE, "d")
scalar("year_of", N.year_of, "coalesce(list_filter(regexp_extract_all(d, '[0-9٠-٩]+'), lambda x: length(x) = 4 AND (starts_with(x, '19') OR starts_with(x, '20')))[1], '')", "d")
_FILES = "regexp_extract_all(f, '[0-9]+(?:\\s*[/\\-–]\\s*[0-9]+){1,3}')"
scalar("split_file_numbers", lambda c: F.array_join(N.split_file_numbers(c), "|"), f"array_to_string(list_transform({_FILES}, lambda x: regexp_replace(trim(x), '\\s*([/\\-–])\\s*', '\\1', 'g')), '|')", "f")
scalar("tidy_number", N.tidy_number, "regexp_replace(trim(f), '\\s*([/\\-–])\\s*', '\\1', 'g')", "f")


def first_of(x: str, pairs: list[tuple[str, str]], otherwise: str = "") -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{k}') THEN '{v}'" for k, v in pairs) + f" ELSE '{otherwise}' END"


_FOLDED = STRIP.replace("{}", "court")
scalar("city_of", N.city_of, first_of(_FOLDED, [(N._fold_str(c), c) for c in N.CITIES]), "court")
_TOP = [("النقض", "نقض"), ("المجلس الاعلي", "نقض"), ("الاستئناف", "استئناف"), ("الاستناف", "استئناف")]
scalar("court_to_level", N.court_to_level, first_of(_FOLDED, [*_TOP, *((c, "ابتدائي") for c in ("الابتدائية", "الادارية", "التجارية"))]), "court")
scalar("level_from_text", N.level_from_text, first_of(_FOLDED, [*_TOP, *((c, "ابتدائي") for c in ("الابتدائية", "المحكمة التجارية", "المحكمة الادارية"))]), "court")
_KIND = f"replace({FIELD.replace('{}', 'court')}, ' ', '')"
scalar("court_kind", N.court_kind, f"CASE WHEN regexp_matches({_KIND}, 'النقض|المجلسالاعلي') THEN 'top' WHEN regexp_matches({_KIND}, 'ست[ئي]?ناف') THEN 'appeal' WHEN regexp_matches({_KIND}, 'بتدائي|المركزالقضائي|(?:التجارية|الادارية)$') THEN 'first-instance' ELSE 'unknown' END", "court")
_DIG = "regexp_replace(n, '[^0-9]', '', 'g')"


@query("sort_key", ["raw"], f"SELECT doc_id, substr(date, 7, 4) || substr(date, 4, 2) || substr(date, 1, 2) || substr(CASE WHEN length({_DIG}) < 6 THEN lpad({_DIG}, 6, '0') ELSE {_DIG} END, 1, 6) AS value FROM raw")
def _(raw: DataFrame) -> DataFrame:
    return raw.select("doc_id", N.sort_key("date", "n").alias("value"))


@query("title_for", ["decisions"], f"SELECT doc_id, array_to_string(list_filter([court, category], lambda x: x NOT IN ('', '{N.UNKNOWN}')), ' — ') AS value FROM decisions")
def _(d: DataFrame) -> DataFrame:
    return d.select("doc_id", N.title_for("court", "category").alias("value"))


_CUT = "400 - position(' ' IN reverse(substr(text, 1, 400)))"


@query("excerpt", ["documents"], f"SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE regexp_replace(CASE WHEN contains(substr(text, 1, 400), ' ') AND {_CUT} > 240 THEN substr(text, 1, {_CUT}) ELSE substr(text, 1, 400) END, '\\s+$', '') || '…' END AS value FROM documents")
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", N.excerpt("text").alias("value"))


@query("collapse_repeat_lines", ["documents"], "SELECT doc_id, (SELECT array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: x[2] = 1 OR x[1] <> l[x[2] - 1]), lambda x: x[1]), chr(10)) FROM (SELECT string_split(text, chr(10)) AS l)) AS value FROM documents")
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", N.collapse_repeat_lines("text").alias("value"))


@query("reflow_lines", ["documents"])
def _(docs: DataFrame) -> DataFrame:
    parts = N.reflow_lines("text")
    return docs.select("doc_id", F.size(parts).alias("paragraphs"), F.size(F.filter(parts, lambda p: p["header"])).alias("headers"), F.sha2(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), 256).alias("digest"))


@query("align_pages", ["conversations"], "SELECT conv_id, array_to_string(list_concat(list(text ORDER BY turn), ['', '', '', ''])[:4], '|') AS value FROM conversations GROUP BY conv_id")
def _(turns: DataFrame) -> DataFrame:
    pages = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("p"))
    return pages.select("conv_id", F.array_join(N.align_pages(F.col("p"), 4), "|").alias("value"))


_MID = "(length(text) // 2)"
_LEFT = f"substr(text, 1, {_MID})"
_BEFORE = f"CASE WHEN contains({_LEFT}, chr(10)) THEN {_MID} - position(chr(10) IN reverse({_LEFT})) ELSE -1 END"
_AFTER = f"CASE WHEN contains(substr(text, {_MID} + 1), chr(10)) THEN {_MID} + position(chr(10) IN substr(text, {_MID} + 1)) - 1 ELSE -1 END"
_AT = f"CASE WHEN ({_BEFORE}) < length(text) // 4 THEN {_AFTER} ELSE {_BEFORE} END"


@query("split_halves", ["documents"], f"SELECT doc_id, substr(text, 1, cut) AS head, substr(text, cut + 1) AS tail FROM (SELECT *, CASE WHEN {_AT} <= 0 THEN {_MID} ELSE {_AT} END AS cut FROM documents)")
def _(docs: DataFrame) -> DataFrame:
    h = N.split_halves("text")
    return docs.select("doc_id", h[0].alias("head"), h[1].alias("tail"))


_TRIM = "regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


@query("head_tail_trim", ["documents"], f"SELECT doc_id, CASE WHEN length(t) <= 10000 THEN t ELSE substr(t, 1, 7000) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || substr(t, -3000) END AS value FROM (SELECT doc_id, {_TRIM} AS t FROM documents)")
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", N.head_tail_trim("text").alias("value"))


@query("token_cost", ["run_state"], "SELECT doc_id, ((input_tokens - output_tokens) * 0.3 + output_tokens * 0.075 + output_tokens * 2.5) / 1000000 AS value FROM run_state")
def _(state: DataFrame) -> DataFrame:
    return state.select("doc_id", N.token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("output_tokens"), 0.3, 2.5, 0.075).alias("value"))


_N = f"regexp_replace({FIELD.replace('{}', 'n')}, '\\s*/\\s*', '/', 'g')"
_A, _B = f"regexp_extract({_N}, '^([0-9]+)(?:/([0-9]+))?$', 1)", f"regexp_extract({_N}, '^([0-9]+)(?:/([0-9]+))?$', 2)"
scalar("display_decision_no", X.display_decision_no, f"CASE WHEN NOT regexp_full_match({_N}, '[0-9]+(/[0-9]+)?') THEN '' WHEN length({_A}) = 1 AND length({_B}) > 1 THEN CAST({_B}::BIGINT AS VARCHAR) ELSE CAST({_A}::BIGINT AS VARCHAR) END", "n")

_D = FIELD.replace("{}", "d")
_MONTH = "CASE regexp_extract(s, '([0-9]{1,2})\\s*([ء-ي]+)\\s*([0-9]{4})', 2) " + " ".join(f"WHEN '{m}' THEN '{i:02d}'" for m, i in X.MONTHS.items()) + " END"
_DATES = f"""coalesce(
  try_strptime(regexp_extract(s, '([0-9]{{1,2}})\\s*([ء-ي]+)\\s*([0-9]{{4}})', 1) || '/' || {_MONTH} || '/' || regexp_extract(s, '([0-9]{{1,2}})\\s*([ء-ي]+)\\s*([0-9]{{4}})', 3), '%d/%m/%Y'),
  try_strptime(regexp_replace(regexp_extract(s, '([0-9]{{4}}\\s*[/.-]\\s*[0-9]{{1,2}}\\s*[/.-]\\s*[0-9]{{1,2}})', 1), '[\\s/.-]+', '/', 'g'), '%Y/%m/%d'),
  try_strptime(regexp_replace(regexp_extract(s, '([0-9]{{1,2}}\\s*[/.-]\\s*[0-9]{{1,2}}\\s*[/.-]\\s*[0-9]{{4}})', 1), '[\\s/.-]+', '/', 'g'), '%d/%m/%Y'))"""


@query("display_date", ["raw"], f"SELECT doc_id, coalesce(strftime({_DATES}, '%d/%m/%Y'), '') AS value FROM (SELECT doc_id, {_D} AS s FROM raw)")
def _(raw: DataFrame) -> DataFrame:
    return raw.select("doc_id", X.display_date("d").alias("value"))


#: Dates with month names that are misspelt, and what they are read as.
MISSPELT = [("{d} فبرابر 2022", "{dd}/02/2022"), ("{d} أكتوبير2018", "{dd}/10/2018"), ("{d} دجنبير ٢٠٠٨", "{dd}/12/2008"), ("{d} يناير 2001", "{dd}/01/2001"), ("{d} كذاوكذا 2001", ""), ("15/10/2015", "15/10/2015")]
_SPELT = "CASE doc_id % 6 " + " ".join("WHEN {} THEN '{}'".format(i, m.replace("{d}", "' || (1 + doc_id % 28) || '")) for i, (m, _) in enumerate(MISSPELT)) + " END"
_MEANT = "CASE doc_id % 6 " + " ".join("WHEN {} THEN '{}'".format(i, m.replace("{dd}", "' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '")) for i, (_, m) in enumerate(MISSPELT)) + " END"


@query("display_date_fuzzy", ["raw"], f"SELECT doc_id, {_MEANT} AS value FROM raw")
def _(raw: DataFrame) -> DataFrame:
    return raw.select("doc_id", X.display_date_fuzzy(F.expr(_SPELT)).alias("value"))


@query("month_lookup", ["raw"], "SELECT doc_id, CASE WHEN contains(d, 'فبراير') THEN 2 WHEN contains(d, 'أكتوبر') THEN 10 WHEN contains(d, 'دجنبر') THEN 12 END AS value FROM raw")
def _(raw: DataFrame) -> DataFrame:
    return raw.select("doc_id", X.month_lookup(F.regexp_replace(N.norm_field("d"), f"[^{X.AR}]", "")).alias("value"))


_R = FIELD.replace("{}", "text")


_HEAD_LEVEL = first_of(STRIP.replace("{}", "text"), [*_TOP, *((c, "ابتدائي") for c in ("الابتدائية", "المحكمة التجارية", "المحكمة الادارية"))])
_SEEN = "regexp_extract(text, '(محكمة النقض|محكمة الاستئناف بفاس|المحكمة الابتدائية بطنجة)', 1)"


@query("extract_identity", ["rulings"], f"""SELECT doc_id, {_HEAD_LEVEL} AS level, {_SEEN} AS court, CASE WHEN contains({_SEEN}, 'فاس') THEN 'فاس' WHEN contains({_SEEN}, 'طنجة') THEN 'طنجة' ELSE '' END AS city,
  regexp_extract(text, 'القرار عدد (\\d+)', 1) AS decision_no, regexp_extract(text, 'المؤرخ في (\\S+)', 1) AS date, regexp_extract(text, 'ملف \\S+ عدد (\\S+)', 1) AS file_no FROM rulings""")
def _(r: DataFrame) -> DataFrame:
    return r.select("doc_id", X.extract_identity("text").alias("i")).select("doc_id", "i.*")


@query("header_date", ["rulings", "orders"], "SELECT doc_id, strftime(o_orderdate, '%d/%m/%Y') AS value FROM rulings JOIN orders ON doc_id = o_orderkey")
def _(r: DataFrame, _o: DataFrame) -> DataFrame:
    return r.select("doc_id", X.header_date(F.replace("text", F.lit("المؤرخ في"), F.lit("الصادر بتاريخ"))).alias("value"))


@query("chamber_from_text", ["rulings"], "SELECT doc_id, CASE WHEN contains(text, 'ملف مدني') THEN 'مدنية' WHEN contains(text, 'ملف شرعي') THEN 'أحوال شخصية' WHEN contains(text, 'ملف تجاري') THEN 'تجارية' WHEN contains(text, 'ملف جنحي') THEN 'جنائية' ELSE '' END AS value FROM rulings")
def _(r: DataFrame) -> DataFrame:
    return r.select("doc_id", X.chamber_from_text("text").alias("value"))


scalar("canonical_city", X.canonical_city, first_of("court", [("فاس", "فاس"), ("بني ملال", "بني ملال"), ("بالبيضاء", "الدار البيضاء"), ("طنجة", "طنجة")]), "court")
scalar("normalize_category", X.normalize_category, first_of(CATEGORY.replace("{}", "category"), X.CATEGORY_TRIGGERS, N.UNKNOWN), "category")


@query("guess_court", ["rulings"], f"SELECT doc_id, {first_of('text', [(c, c) for c in X.COURTS])} AS value FROM rulings")
def _(r: DataFrame) -> DataFrame:
    return r.select("doc_id", X.guess_court("text").alias("value"))


@query("resolve_category", ["decisions"], f"SELECT doc_id, CASE WHEN category NOT IN ('', '{N.UNKNOWN}') THEN category WHEN theme <> '' THEN theme WHEN city <> '' THEN CASE WHEN k % 2 = 0 THEN 'تجارية' ELSE '{N.UNKNOWN}' END ELSE '{N.UNKNOWN}' END AS value, CASE WHEN category NOT IN ('', '{N.UNKNOWN}') THEN 'ruling-text' WHEN theme <> '' THEN 'model' WHEN city <> '' THEN 'assumed-from-folder' ELSE 'undetermined' END AS source FROM decisions")
def _(d: DataFrame) -> DataFrame:
    return d.select("doc_id", X.resolve_category(F.col("category"), F.col("theme"), F.when(F.col("city") == "", "").when(F.col("k") % 2 == 0, "الغرفة التجارية").otherwise("x")).alias("c")).select("doc_id", "c.*")


@query("reconcile_field", ["raw"], "SELECT doc_id, CASE WHEN m <> '' AND m = p THEN 0.97 WHEN m <> '' THEN 0.9 WHEN p <> '' THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN m <> '' THEN m ELSE p END AS value, CASE WHEN m <> '' AND m = p THEN 'llm+regex' WHEN m <> '' THEN 'llm' WHEN p <> '' THEN 'regex' ELSE 'none' END AS source FROM (SELECT doc_id, lower(trim(n)) AS m, lower(trim(CASE WHEN doc_id % 4 = 0 THEN n ELSE f END)) AS p FROM raw)")
def _(raw: DataFrame) -> DataFrame:
    r = X.reconcile_field(F.col("n"), F.when(F.col("doc_id") % 4 == 0, F.col("n")).otherwise(F.col("f")), F.lower)
    return raw.select("doc_id", r["confidence"].alias("confidence"), r["value"].alias("value"), r["source"].alias("source"))


@query("pick_identity", ["raw"], "SELECT doc_id, CASE WHEN trim(n) <> '' THEN trim(n) ELSE f END AS number, CASE WHEN trim(court) <> '' THEN trim(court) ELSE category END AS court FROM raw")
def _(raw: DataFrame) -> DataFrame:
    r = raw.select("doc_id", F.struct(F.col("n").alias("number"), "court").alias("m"), F.struct(F.col("f").alias("number"), F.col("category").alias("court")).alias("l"))
    return r.select("doc_id", X.pick_identity(F.col("m"), F.col("l"), ["number", "court"]).alias("p")).select("doc_id", "p.*")


@query("outcome", ["rulings"], "SELECT doc_id, CASE WHEN contains(text, chr(10) || 'رفض الطلب' || chr(10)) THEN 'رفض الطلب' WHEN contains(text, 'نقض وإحالة .') THEN 'نقض وإحالة' WHEN contains(text, 'برفض الطلب') THEN 'رفض الطلب' WHEN contains(text, 'بنقض وإبطال') THEN 'نقض وإبطال' WHEN contains(text, 'بعدم القبول') THEN 'عدم القبول' ELSE '' END AS value FROM rulings")
def _(r: DataFrame) -> DataFrame:
    return r.select("doc_id", X.outcome("text").alias("value"))


#: Opening lines of rulings, and what is read from each: subject, sub-issues and consequence joined, and the rule.
HEADNOTES = [
    ("في الملف المدني عدد 1852/1/3/2019 الكراء التجاري - شروطه - أثره. القاعدة الأولى رقم {k}", "الكراء التجاري", "الكراء التجاري - شروطه - أثره", "القاعدة الأولى رقم {k}"),
    ("القرار 12 في الملف عدد 7/8/2011 إثبات النسب – الخبرة الطبية (نعم) إن المحكمة لما قضت بذلك {k}", "إثبات النسب", "إثبات النسب - الخبرة الطبية (نعم", "إن المحكمة لما قضت بذلك {k}"),
    ("حيث إن الملف عدد 5/6/2012 الشفعة - أجلها. قاعدة {k}", "", "", ""),
    ("ملف عدد 9/9/2013 من طرف الطالب المذكور بواسطة نائبه {k}", "", "", ""),
    ("في الملف عدد 4/4/2014 الحضانة. قصير", "", "", ""),
    ("في المـلف عدد 4/5/2014 بناء على المقال - الحضانة - مشروعيتها. قاعدة {k}", "الحضانة", "الحضانة - مشروعيتها", "قاعدة {k}"),
    ("لا شيء من ذلك {k}", "", "", ""),
]


def by_headnote(part: int, key: str = "doc_id") -> str:
    """A part of the headnotes above by a number: the line itself, subject, keywords or rule."""
    return f"CASE {key} % {len(HEADNOTES)} " + " ".join("WHEN {} THEN '{}'".format(i, h[part].replace("{k}", f"' || {key} || '")) for i, h in enumerate(HEADNOTES)) + " END"


HEADNOTE_KEY = "CASE WHEN {} = 'الكراء التجاري' THEN 'كراء التجاري' WHEN {} = 'الحضانة' THEN 'حضانة' ELSE replace({}, 'إ', 'ا') END"


@query("parse_headnote", ["rulings"], f"SELECT doc_id, theme, {HEADNOTE_KEY.replace('{}', 'theme')} AS theme_key, keywords, rule, CASE WHEN theme = '' THEN '' ELSE 'court' END AS theme_source FROM (SELECT doc_id, {by_headnote(1)} AS theme, {by_headnote(2)} AS keywords, {by_headnote(3)} AS rule FROM rulings)")
def _(r: DataFrame) -> DataFrame:
    noted = r.select("doc_id", F.concat(F.expr(by_headnote(0)), F.lit("\n"), "text").alias("text"))
    return noted.select("doc_id", X.headnote_fields(X.parse_headnote("text")).alias("h")).select("doc_id", "h.*")


#: Citations far behind a text: none, of one file, of two files, of no file, and of two courts; and the references in each.
CITED = [
    ("", []),
    (" ضد القرار عدد {k} بتاريخ 1/2/2016 في الملف عدد {k}/5/2015 الصادر عن محكمة الاستئناف بفاس", [("محكمة الاستئناف بفاس", "فاس", "{k}", "1/2/2016", "{k}/5/2015")]),
    (" ضد القرار رقم 12 بتاريخ 3/4/2017 في الملفين عدد 4/5/2015 و 6 / 7/2016 عن المحكمة الابتدائية بطنجة", [("المحكمة الابتدائية بطنجة", "طنجة", "12", "3/4/2017", "4/5/2015"), ("المحكمة الابتدائية بطنجة", "طنجة", "12", "3/4/2017", "6/7/2016")]),
    (" بعد الحكم عدد {k} الصادر عن المحكمة التجارية بالبيضاء", [("المحكمة التجارية بالبيضاء", "البيضاء", "{k}", "", "")]),
    (" الحكم عدد 5 عن المحكمة الابتدائية بطنجة، المؤيد بالقرار رقم 9 عن محكمة الاستئناف بفاس", [("المحكمة الابتدائية بطنجة", "طنجة", "5", "", ""), ("محكمة الاستئناف بفاس", "فاس", "5", "", "")]),
]
_CITING = "repeat(' كذا', 80) || CASE doc_id % 5 " + " ".join("WHEN {} THEN '{}'".format(i, c.replace("{k}", "' || doc_id || '")) for i, (c, _) in enumerate(CITED)) + " END"
_REFERENCES = " UNION ALL ".join(
    "SELECT doc_id, {}::INT AS ref_ix, {} FROM rulings WHERE doc_id % 5 = {}".format(n, ", ".join("'{}' AS {}".format(v.replace("{k}", "' || doc_id || '"), f) for v, f in zip(ref, ["court", "city", "decision_no", "date", "file_no"], strict=True)), i)
    for i, (_, refs) in enumerate(CITED)
    for n, ref in enumerate(refs)
)


@query("extract_refs", ["rulings"], _REFERENCES)
def _(r: DataFrame) -> DataFrame:
    return X.extract_refs(r.select("doc_id", F.concat("text", F.expr(_CITING)).alias("text")))


_GATES = {k: p.replace("\\", "\\\\").replace("\\\\", "\\") for k, p in P.GATE_PATTERNS.items()}


@query("pii_gate", ["documents"], "SELECT doc_id, kind, value FROM (" + " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{k}' AS kind, trim(unnest(regexp_extract_all(text, '{p}'))) AS value FROM documents" for k, p in _GATES.items()) + ")")
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(P.pii_gate("text")).alias("p")).select("doc_id", F.col("p.type").alias("kind"), "p.value").distinct()


def _redact_sql() -> tuple[str, str]:
    s, hits = "text", []
    for p in P.REDACT_PATTERNS:
        hits.append(f"len(regexp_extract_all({s}, '{p}'))")
        s = f"regexp_replace({s}, '{p}', '{P.TOKEN}', 'g')"
    return s, " + ".join(hits)


@query("redact_structured", ["documents"], f"SELECT doc_id, sha256({_redact_sql()[0]}) AS digest, ({_redact_sql()[1]})::INT AS hits FROM documents")
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", P.redact_structured("text").alias("r")).select("doc_id", F.sha2("r.text", 256).alias("digest"), "r.hits")


#: A noisy string, or initials in its place.
NAMED = "CASE doc_id % 5 WHEN 0 THEN 'ع. ح' WHEN 1 THEN ' A B-C ' WHEN 2 THEN '...' ELSE s END"
_RUNS = r"list_filter(regexp_split_to_array(s, '[^\p{L}\p{N}]+'), lambda x: x <> '')"


for _name in ("is_initials", "is_initials_whole"):

    @query(_name, ["raw"], f"SELECT doc_id, len({_RUNS}) > 0 AND len(list_filter({_RUNS}, lambda x: length(x) <> 1)) = 0 AS value FROM (SELECT doc_id, {g(NAMED, '[ـً-ٰٟ]', ' ')} AS s FROM raw)")
    def _(raw: DataFrame) -> DataFrame:
        """Strings of single letters, and longer ones."""
        return raw.select("doc_id", P.is_initials(F.expr(NAMED)).alias("value"))


scalar("significant_len", P.significant_len, f"length({g('s', '[' + chr(92) + 'sـً-ٰٟ]')})", "s")


@query("name_variants", ["raw"], "SELECT doc_id, CASE WHEN len(w) > 1 THEN s || '|' || array_to_string(list_reverse(w), ' ') ELSE s END AS value FROM (SELECT doc_id, court AS s, string_split(court, ' ') AS w FROM raw)")
def _(raw: DataFrame) -> DataFrame:
    return raw.select("doc_id", F.array_join(P.name_variants("court"), "|").alias("value"))


_LETTERS = f"string_split({g('court', '[' + chr(92) + 'sـً-ٰٟ]')}, '')"
_FLEXIBLE = f"array_to_string(list_transform(list_filter({_LETTERS}, lambda x: x <> ''), lambda x: CASE WHEN contains('{P.ALEF_CLASS}', x) THEN '[{P.ALEF_CLASS}]' WHEN contains('{P.YA_CLASS}', x) THEN '[{P.YA_CLASS}]' ELSE x END), '{P.BETWEEN}')"


@query("name_pattern", ["raw"], f"SELECT doc_id, CASE WHEN n <= {P.SHORT} THEN '{P.WORD_START}(?:' || p || '){P.WORD_END}' ELSE p END AS value, CASE WHEN n = 0 THEN 0 WHEN n <= {P.SHORT} THEN 1 ELSE 2 END::INT AS hits FROM (SELECT doc_id, {_FLEXIBLE} AS p, length({g('court', '[' + chr(92) + 'sـً-ٰٟ]')}) AS n FROM raw)")
def _(raw: DataFrame) -> DataFrame:
    """Each name's pattern, and how often it is found in a text that holds the name twice, once between letters and spread out."""
    spread = F.array_join(F.filter(F.split("court", ""), lambda x: x != " "), "ـ ")
    body = F.when(F.col("court") == "", "").otherwise(F.concat(F.col("court"), F.lit(" سس"), spread, F.lit("سس")))
    pattern = P.name_pattern("court")
    return raw.select("doc_id", pattern.alias("value"), F.when(F.col("court") == "", 0).otherwise(F.regexp_count(body, pattern)).alias("hits"))


@query("drop_institutions", ["decisions"], "SELECT doc_id, array_to_string(list_filter([court, city, theme], lambda x: trim(x) <> '' AND NOT contains(x, 'محكمة')), '|') AS value FROM decisions")
def _(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.array_join(P.drop_institutions(F.array("court", "city", "theme")), "|").alias("value"))


for _name in ("abstract_guard", "abstract_guard_whole"):

    @query(_name, ["documents"], "SELECT doc_id, CASE WHEN length(trim(t)) < 60 THEN 'short' WHEN regexp_matches(trim(t), '\\(.{1,3}\\.') THEN 'names' ELSE '' END AS value FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
    def _(docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", P.abstract_guard("text").alias("value"))


BAD, ARABIC = r"[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{E000}-\x{F8FF}\x{0180}-\x{024F}]", r"[\x{0600}-\x{06FF}]"


def unreadable(limit: str) -> str:
    return f"(n >= 200 AND (bad / greatest(bad + arab, 1) > {limit} OR (bad + arab) / n < 0.15))"


_COUNTS = f"SELECT doc_id, len(regexp_extract_all(t, '{BAD}')) AS bad, len(regexp_extract_all(t, '{ARABIC}')) AS arab, length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS n FROM (SELECT doc_id, repeat(s, 12) || CASE WHEN doc_id % 3 = 0 THEN substr('{'a' * 400}', 1, (doc_id % 400)::INT) ELSE '' END AS t FROM raw)"
for _name, _fn, _limit in (("ocr_garbled", Q.ocr_garbled, "0.15"), ("text_layer_unreliable", Q.text_layer_unreliable, "0.03")):

    @query(_name, ["raw"], f"SELECT doc_id, {unreadable(_limit)} AS value FROM ({_COUNTS})")
    def _(raw: DataFrame, fn: Callable = _fn) -> DataFrame:
        more = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("a"), (F.col("doc_id") % 400).cast("int"))).otherwise("")
        return raw.select("doc_id", fn(F.concat(F.repeat("s", F.lit(12)), more)).alias("value"))
