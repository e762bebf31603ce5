"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import _shared, ann, chat, decontaminate, language_id, lexical_search, mixing, ngram_join, pii_spans, suffix_dedup, superkmer_dedup, token_alignment, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Verdict, host and path of the registered URL rules.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeated_bytes(docs, with_text=False).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.turns_as_calls(_table(spark, sf_dir, "conversations"))
    return chat.link_calls(turns, chat.ASK).select("conv_id", "turn", "kind", "call_id", "rank", "linked", "valid", "message")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared.scratch(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    pages = warc.pages_of(warc.reassemble(warc.read_records(spark, path)))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def op10_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return superkmer_dedup.remove_repeated_words(docs, with_text=False).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align_documents(docs).select("doc_id", *token_alignment.MEASURES, "n_best", "count_sum", "groups_sha256")


def op12_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans.find_private(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii_spans.BASE_KINDS))
    counts = [pii_spans.count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii_spans.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii_spans.listed(base), 256).alias("base_sha256"), pii_spans.listed(F.col("spans")).alias("spans"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op1_ngram_links": op1_ngram_jaccard,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_nearest": op4_nearest,
    "op5_mix_sources": op5_mix_sources,
    "op6_language_id": op6_language_id,
    "op7_chat_format": op7_chat_format,
    "op8_url_filter": op8_url_filter,
    "op9_warc": op9_warc,
    "op10_superkmer_dedup": op10_superkmer_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_pii_spans": op12_pii_spans,
    "op13_lexical_search": op13_lexical_search,
}

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SPLIT = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op10_superkmer_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_SPLIT.format('text')}, []) AS w FROM documents),
v AS (SELECT k, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 11, 1))) AS t(i)),
f AS (SELECT s, min(doc_id) AS f FROM v GROUP BY s),
h AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS j FROM v JOIN f USING (s) WHERE doc_id > f),
g AS (SELECT k, list(j) AS gone FROM h GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(coalesce(gone, []), x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (k)""",
    "op2_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all({_LOWERED.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, lens, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
hit AS (SELECT k, i, n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT k, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(j) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM hit) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)""",
    "op7_chat_format": """
WITH m AS (SELECT conv_id, turn, role, text,
  CASE WHEN conv_id IS NULL OR turn IS NULL OR role IS NULL THEN 'message' WHEN role = 'user' THEN 'call' WHEN role = 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE WHEN conv_id IS NOT NULL AND role = 'user' THEN conv_id || ':' || turn WHEN conv_id IS NOT NULL AND role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM conversations),
c AS (SELECT call_id, min(CASE WHEN kind = 'call' THEN turn END) AS called, min(CASE WHEN kind = 'result' THEN turn END) AS answered,
      bool_and(CASE WHEN kind = 'call' THEN text IS NOT NULL END) AS good FROM m WHERE call_id IS NOT NULL GROUP BY call_id),
e AS (SELECT * FROM c WHERE called IS NOT NULL AND answered IS NOT NULL)
SELECT conv_id, turn, kind, m.call_id AS call_id,
  (CASE WHEN kind = 'result' AND called IS NOT NULL THEN 2 * called + 1 ELSE 2 * turn END)::BIGINT AS rank,
  CASE WHEN kind <> 'message' THEN called IS NOT NULL END AS linked,
  CASE WHEN kind = 'call' THEN text IS NOT NULL WHEN kind = 'result' THEN good END AS valid,
  CASE WHEN kind = 'call' THEN json_object('arguments', json_object('length', length(text), 'text', text)::VARCHAR, 'call_id', m.call_id, 'name', 'ask', 'role', role)::VARCHAR
       WHEN kind = 'result' THEN json_object('call_id', m.call_id, 'content', text, 'role', 'tool')::VARCHAR
       ELSE json_object('content', text, 'role', role)::VARCHAR END AS message
FROM m LEFT JOIN e USING (call_id)""",
    "op8_url_filter": rf"""
WITH p AS (SELECT page_id, coalesce({_LOWERED.format("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")}, '') AS host,
                  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, q) AS (VALUES {', '.join(f"('{v}', '{h}', '{q}')" for v, h, q in URL_RULES)}),
f AS (SELECT host, path, arg_max(h || q, length(h || q) * 1000 + length(h)) AS rule, arg_max(verdict, length(h || q) * 1000 + length(h)) AS verdict
      FROM (SELECT DISTINCT host, path FROM p), r WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, q) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (host, path)""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to, 'ok' AS status
FROM p LEFT JOIN f ON p.digest = f.digest""",
    "op13_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all({_LOWERED.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term, n_docs),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOWERED.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
m AS (SELECT k, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM d, s),
c AS (SELECT q, item_id, doc_id, k, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM t JOIN f USING (term) JOIN i USING (term) JOIN m USING (k) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10""",
}

ORACLES["op1_ngram_jaccard"] = ORACLES["op1_ngram_links"] = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_SPLIT.format(_LOWERED.format('text'))}, []) AS w FROM documents),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END)) AS t(i)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.k = c.a JOIN n y ON y.k = c.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT k AS node, k AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node AS k, min(doc_id) AS component_id FROM r JOIN d ON d.k = r.root GROUP BY node),
q AS (SELECT a AS k, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM d LEFT JOIN n USING (k) JOIN m USING (k) LEFT JOIN q USING (k)"""
