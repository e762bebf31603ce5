"""Views over the tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from docloom.plans.registry import VIEWS


def pick(value: str, *options: str) -> str:
    """One of the options by a number."""
    return f"CASE {value} % {len(options)} " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options)) + " END"


_DATE = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)"
_KEY = "CAST(o_orderkey AS STRING)"

#: Noisy strings of every kind the normalisers and keys take.
VIEWS["raw"] = f"""SELECT o_orderkey AS doc_id,
  {pick('o_orderkey', 'الأُسْتَاذ  ', 'محكمة إبتدائية', ' القرار عــدد ٣', 'الى المجلسِ', 'ٱلكراء والإثبات ة ', 'Étude  CAS ')} || {_KEY} || {pick('o_custkey', '', '  نهى ', ' آخر')} AS s,
  {pick('o_orderkey', '12 / 8201 / 2015', 'ملف ', '444-1606-16', '95/1622/99', '8888', '', '7 7/3/19')} || {pick('o_custkey', '', '/', '-3', ' و12/5/2016')} AS f,
  {pick('o_orderkey', '15/10/2015', '2021-02-23', '26-11-2019', '8/3/', '31/02/2020', '', '2014', 'يوم 18 / 07 /2016 مساء', '08 فبراير 2022', '16 أكتوبر2018', '17 دجنبر ٢٠٠٨')} AS d,
  {pick('o_orderkey', '58', '058', '33/1', '2 / 96', '٥٨', '2019/1/2/669', 'none', '', '1/7')} AS n,
  {pick('o_orderkey', 'محكمة النقض', 'محكمة الاستئناف بفاس', 'المحكمة الابتدائية ببني ملال', 'المحكمة التجارية بالبيضاء', 'المجلس الأعلى', 'محكمة الإستيناف بطنجة', 'مركز', '')} AS court,
  {pick('o_custkey', 'الغرفة التجارية', 'إدارية', 'أحوال شخصية', 'جنائي', '', 'غير ذلك', 'عقاري مدني')} AS category,
  {_DATE} AS date, o_totalprice AS price, year(o_orderdate) AS y
FROM {{orders}}"""

#: Short rulings.
VIEWS["rulings"] = f"""SELECT o_orderkey AS doc_id,
  {pick('o_orderkey', 'المملكة المغربية', 'باسم جلالة الملك', 'نشرة قرارات', 'قرار')} || chr(10) ||
  {pick('o_orderkey', 'محكمة النقض', 'محكمة الاستئناف بفاس', 'المحكمة الابتدائية بطنجة')} || chr(10) ||
  'القرار عدد ' || CAST(o_orderkey % 997 AS STRING) || ' المؤرخ في ' || {_DATE} || chr(10) ||
  'ملف ' || {pick('o_custkey', 'مدني', 'شرعي', 'تجاري', 'جنحي')} || ' عدد ' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey % 7 AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) || chr(10) ||
  {pick('o_orderkey', 'رفض الطلب', 'عرض الوقائع', 'نقض وإحالة .', 'حيث إن الطاعن')} || chr(10) || 'وقائع النازلة رقم ' || {_KEY} || chr(10) ||
  {pick('o_custkey', 'لهذه الأسباب قضت محكمة النقض برفض الطلب', 'لهذه الأسباب بنقض وإبطال القرار', 'انتهى', 'لهذه الأسباب بعدم القبول وتسجيل التنازل')} AS text
FROM {{orders}}"""

#: Decisions of the catalogue.
VIEWS["decisions"] = f"""SELECT 'D' || {_KEY} AS doc_id, o_orderkey AS k,
  {pick('o_orderkey', 'إدارية', 'تجارية', 'مدنية', 'جنائية', 'اجتماعية', 'أحوال شخصية', 'عقارية', '', 'غير محدد')} AS category,
  {pick('o_orderkey', 'ابتدائي', 'استئناف', 'نقض')} AS level,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE {pick('o_orderkey', 'المحكمة الابتدائية', 'محكمة الاستئناف', 'محكمة النقض')} END AS court,
  {pick('o_custkey', 'فاس', 'طنجة', 'تازة', 'الرباط', '', 'سلا')} AS city,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_orderkey % 997 AS STRING) END AS decision_no,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey % 7 AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) END AS file_no,
  {_DATE} AS decision_date, CAST(year(o_orderdate) AS STRING) AS year,
  CAST(year(o_orderdate) AS STRING) || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || lpad(CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_orderkey % 997 AS STRING) END, 6, '0') AS sort_key,
  {pick('o_custkey', 'الكراء', 'كراء', 'إثبات', 'اثبات', '', 'الإثبات بالشهود', 'طلاق')} AS theme,
  {pick('o_custkey', 'كراء', 'كراء', 'اثبات', 'اثبات', '', 'اثبات بالشهود', 'طلاق')} AS theme_key,
  {pick('o_custkey', 'court', 'court', 'model', 'court', '', 'court', 'model')} AS theme_source,
  {pick('o_orderkey', 'published', 'published', 'imported', 'under_review', 'withdrawn')} AS state,
  {pick('o_custkey', 'ok', 'check', 'ok')} AS review,
  CASE WHEN o_orderkey % 19 = 0 THEN o_orderdate END AS edited_at, CASE WHEN o_orderkey % 19 = 0 THEN 'admin' ELSE '' END AS edited_by, o_orderdate AS updated_at,
  CAST(o_orderkey % 4 AS INT) AS version,
  'قرار رقم ' || {_KEY} || chr(10) || {pick('o_orderkey', 'أداء التعويض عن الضرر', 'فسخ عقد الكراء', 'الطلاق للشقاق', 'النزاع الإداري')} || chr(10) || o_orderpriority AS body_text,
  'قرار رقم ' || {_KEY} || ' ' || {pick('o_orderkey', 'اداء التعويض عن الضرر', 'فسخ عقد الكراء', 'الطلاق للشقاق', 'النزاع الاداري')} || ' ' || lower(o_orderpriority) AS search_text,
  CASE WHEN o_custkey % 5 = 0 THEN 'ملخص' ELSE '' END AS abstract, CASE WHEN o_custkey % 4 = 0 THEN 'القاعدة' ELSE '' END AS rule,
  CASE WHEN o_custkey % 3 = 0 THEN 'رفض الطلب' ELSE '' END AS outcome, o_custkey AS actor_id
FROM {{orders}}"""

#: Records that a later run delivers for some decisions, and new ones.
VIEWS["records"] = f"""SELECT 'D' || CAST(o_orderkey + CASE WHEN o_orderkey % 6 = 0 THEN 100000000 ELSE 0 END AS STRING) AS doc_id, o_orderkey AS k,
  {pick('o_custkey', 'مدنية', 'تجارية', '')} AS category, CAST(o_orderkey % 991 AS STRING) AS decision_no, {_DATE} AS decision_date,
  CASE WHEN o_orderkey % 23 = 0 THEN 'failed' ELSE 'done' END AS status, o_orderkey % 29 = 0 AS quarantined,
  'f' || CAST(o_orderkey % 50000 AS STRING) AS file_name, {pick('o_orderkey', 'a', 'b')} AS folder, {pick('o_custkey', 'pdf', 'docx')} AS format,
  {pick('o_custkey', 'فاس', '', 'سلا')} AS city, o_totalprice / 1000000 AS cost, CAST(o_orderkey % 5 AS INT) AS pages, o_orderkey % 31 <> 0 AS leak_passed, CAST(year(o_orderdate) AS STRING) AS year,
  'نص ' || {_KEY} || {pick('o_orderkey', '', '', ' هاتف 0612345678 .', ' ahmed@mail.com')} AS text, CASE WHEN o_orderkey % 37 = 0 THEN 'damaged' ELSE '' END AS error
FROM {{orders}} WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"""

#: Rulings with the keys that link them: cassations and appeals refer to earlier orders of the same customer.
VIEWS["case_docs"] = f"""SELECT o_orderkey AS doc_id,
  {pick('o_orderkey', 'ابتدائي', 'استئناف', 'نقض', '')} AS level,
  {pick('o_orderkey', 'المحكمة الابتدائية بفاس', 'محكمة الاستئناف بفاس', 'محكمة النقض', '')} AS court,
  {pick('o_custkey', 'فاس', 'طنجة', '')} AS city, CAST(o_orderkey % 101 AS STRING) AS decision_no, {_DATE} AS date,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(o_custkey AS STRING) || {pick('o_orderkey', '/', '-')} || CAST(o_orderkey % 1000 AS STRING) || '/2015' END AS file_no,
  {pick('o_orderkey', 'مدنية', '', 'تجارية')} AS category, {pick('o_custkey', 'north', 'south')} AS corpus
FROM {{orders}}"""

VIEWS["case_refs"] = f"""SELECT h.doc_id, CAST(l.doc_id % 3 AS INT) AS ref_ix, l.court, l.city, l.decision_no, l.date,
  CASE WHEN h.doc_id % 5 = 0 THEN '' WHEN h.doc_id % 4 = 1 THEN replace(l.file_no, '/', '-') ELSE l.file_no END AS file_no
FROM (SELECT o_custkey, o_orderkey AS hi, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS lo FROM {{orders}}) p
JOIN {{case_docs}} h ON h.doc_id = p.hi JOIN {{case_docs}} l ON l.doc_id = p.lo"""

#: Edges between successive orders of a customer.
VIEWS["edges"] = f"""SELECT hi AS parent_doc, lo AS child_doc, {pick('hi', 'high', 'medium', 'high')} AS confidence
FROM (SELECT o_orderkey AS hi, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS lo FROM {{orders}}) p WHERE lo IS NOT NULL AND hi % 4 <> 0"""

#: Documents with a hash, of which some are stored or done; run state; activity.
VIEWS["hashed"] = "SELECT doc_id, md5(text) AS hash, source, text FROM {documents}"
#: Documents as scans are read: some with Arabic text behind their own, and with a name that the gate must find; copies stay copies.
_NTH = "(instr('0123456789abcdef', substr(md5(text), 1, 1)) - 1)"
VIEWS["scans"] = f"""SELECT doc_id, md5(text) AS hash, source, text || CASE WHEN {_NTH} % 4 = 0 THEN '' ELSE ' ' || repeat('قضت المحكمة بما يلي ', 10 + CAST(floor(length(text) / 20) AS INT)) END
  || {pick(_NTH, ' وحضر محمد العلوي ', ' وحضر محؐمد العلوي ', ' انتهى', ' هاتف 0612345678 .', ' ')} AS text FROM {{documents}}"""
VIEWS["known"] = "SELECT md5(text) AS hash, doc_id + CASE WHEN doc_id % 3 = 0 THEN 1000000000 ELSE 0 END AS doc_id FROM {documents} WHERE doc_id % 7 = 0"
VIEWS["done"] = "SELECT doc_id FROM {documents} WHERE doc_id % 5 = 0"
VIEWS["run_state"] = f"""SELECT o_orderkey AS doc_id, {pick('o_orderkey', 'done', 'failed', 'duplicate', 'done', 'done')} AS status, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'out' END AS output,
  CAST(o_orderkey % 9 AS INT) AS pages, CAST(o_custkey % 4 AS INT) AS pii_count, o_orderkey % 1000 AS input_tokens, o_custkey % 100 AS output_tokens, o_totalprice / 1000000 AS cost, '' AS error FROM {{orders}}"""
VIEWS["activity"] = "SELECT event_id, user_id AS actor, event_type AS action, ts, value FROM {events}"
VIEWS["versions"] = f"""SELECT 'D' || CAST(l_orderkey AS STRING) AS doc_id, l_orderkey * 10 + l_linenumber AS row_id, l_linenumber AS version, {pick('l_partkey', 'applied', 'applied', 'draft', 'discarded')} AS status,
  'edit' AS action, l_returnflag AS actor, 'v' || CAST(l_linenumber AS STRING) AS body_text, l_shipdate AS ts FROM {{lineitem}}"""
VIEWS["proposals"] = f"""SELECT 'D' || {_KEY} AS doc_id, {pick('o_orderkey', 'مدنية', 'تجارية', 'إدارية')} AS chamber,
  {pick('o_custkey', 'كراء', 'الكراء', 'الاثبات بالشهود', 'إثبات', 'نفقة', 'النفقة', 'شركة  تجارية')} AS proposed FROM {{orders}}"""
VIEWS["reports"] = f"""SELECT event_id AS report_id, event_id AS row_id, user_id AS reporter, 'D' || CAST(event_id % 1000 AS STRING) AS doc_id, ts, {pick('event_id', 'open', 'closed')} AS status, event_type AS quote FROM {{events}}"""
