"""Detector replies: JSON in several wrappings, repaired where quotes or backslashes are stray; what cannot be read is an error row."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import normalise as N
from docloom.functions.udf import batch_helper

MAX_REPAIRS = 200
_PII = "array<struct<text:string,type:string>>"
_IDENT = "struct<level:string,court:string,city:string,decision_no:string,date:string,file_no:string,outcome:string>"
_REFS = "array<struct<court:string,city:string,decision_no:string,date:string,file_no:string>>"
RESULT = f"struct<pages:array<string>,pii:{_PII},court:string,category:string,own:{_IDENT},refs:{_REFS}>"


def repaired(reply: str) -> str | None:
    """The reply with stray quotes and illegal backslashes escaped until it parses; None if it does not, or if a finding was lost."""
    s, expected = reply, len(re.findall(r'"text"\s*:', reply))
    for _ in range(MAX_REPAIRS):
        try:
            got = json.loads(s)
        except json.JSONDecodeError as e:
            s2 = _escape_before(s, e)
            if s2 is None or s2 == s:
                return None
            s = s2
        else:
            return s if json.dumps(got).count('"text":') >= expected else None
    return None


def _escape_before(s: str, e: json.JSONDecodeError) -> str | None:
    if "escape" in e.msg:
        return s[: e.pos] + "\\" + s[e.pos :]
    quote = s.rfind('"', 0, e.pos)
    while quote > 0 and s[quote - 1] == "\\":
        quote = s.rfind('"', 0, quote)
    return s[:quote] + "\\" + s[quote:] if quote > 0 else None


@batch_helper("string")
def _repair_udf(replies: pd.Series) -> pd.Series:
    return replies.map(lambda r: None if r is None else repaired(r))


def _unwrapped(c: Column) -> Column:
    """The JSON in a reply: without a fence, from the first bracket to the last."""
    s = F.regexp_replace(N.strip(N.text(c)), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    span = F.regexp_extract(s, r"(?s)([{\[].*[}\]])", 1)
    return F.when(span != "", span).otherwise(s)


def _parsed(s: Column) -> Column:
    """Results of an object, of a list of results, or of a bare list of findings; null if nothing fits."""
    first = F.substring(s, 1, 1)
    listed = F.from_json(s, f"array<{RESULT}>")
    findings = F.from_json(s, _PII)
    bare = F.from_json(F.concat(F.lit('{"pii":'), s, F.lit("}")), RESULT)
    is_bare = F.exists(findings, lambda x: x["text"].isNotNull())
    one = F.from_json(s, RESULT)
    filled = one["pages"].isNotNull() | one["pii"].isNotNull() | one["own"].isNotNull() | one["refs"].isNotNull()
    return F.when(first == "{", F.when(filled, F.array(one))).when((first == "[") & is_bare, F.array(bare)).when((first == "[") & listed.isNotNull(), listed)


def read_replies(replies: DataFrame, key: list[str], reply: str = "reply") -> DataFrame:
    """key, result and error of each reply. Only what does not parse reaches the repair."""
    s = _unwrapped(F.col(reply))
    bad = F.try_parse_json(s).isNull()
    got = replies.select(*key, s.alias("_s"), bad.alias("_bad"))
    fixed = _repair_udf(F.when(F.col("_bad"), F.col("_s")))
    got = got.withColumn("_s", F.when(F.col("_bad"), fixed).otherwise(F.col("_s"))).withColumn("_r", _parsed(F.col("_s")))
    usable = F.col("_r").isNotNull() & (F.size("_r") > 0)
    return got.select(*key, F.when(usable, merge_results(F.col("_r"))).alias("result"), F.when(usable, "").otherwise("unusable reply").alias("error"))


def merge_results(results: Column) -> Column:
    """Several results as one: lists joined, of each scalar the first that is not blank."""
    lists = lambda f, kind: F.flatten(F.transform(results, lambda r: F.coalesce(r[f], F.array().cast(kind)))).alias(f)
    first = lambda f: F.coalesce(F.get(F.filter(F.transform(results, lambda r: F.trim(N.text(r[f]))), lambda x: x != ""), F.lit(0)), F.lit("")).alias(f)
    own = F.get(F.filter(F.transform(results, lambda r: r["own"]), lambda o: o.isNotNull()), F.lit(0)).alias("own")
    return F.struct(lists("pages", "array<string>"), lists("pii", _PII), first("court"), first("category"), own, lists("refs", _REFS))


def clean_reply_rows(result: Column) -> Column:
    """Findings without text and references without a number are dropped; nulls become empty strings."""
    pii_ = F.filter(F.transform(result["pii"], lambda p: F.struct(N.text(p["text"]).alias("text"), F.coalesce(p["type"], F.lit("other")).alias("type"))), lambda p: F.trim(p["text"]) != "")
    names = ["court", "city", "decision_no", "date", "file_no"]
    refs = F.filter(F.transform(result["refs"], lambda r: F.struct(*[N.text(r[n]).alias(n) for n in names])), lambda r: (F.trim(r["decision_no"]) != "") | (F.trim(r["file_no"]) != ""))
    return F.struct(result["pages"].alias("pages"), pii_.alias("pii"), result["court"].alias("court"), result["category"].alias("category"), result["own"].alias("own"), refs.alias("refs"))


def merge_refs(refs: DataFrame, extra: DataFrame, as_of_year: int, id: str = "doc_id") -> DataFrame:
    """References of a model, split by file number, then those of the patterns; without a key they go, of equal keys the first stays."""
    split = refs.select(id, "ref_ix", "court", "city", "decision_no", "date", F.posexplode(N.split_file_numbers("file_no")).alias("_part", "file_no"))
    both = split.withColumn("_from", F.lit(0)).unionByName(extra.select(id, "ref_ix", "court", "city", "decision_no", "date", "file_no").withColumns({"_from": F.lit(1), "_part": F.lit(0)}))
    key = F.coalesce(F.nullif(N.canon_file_no("file_no", as_of_year), F.lit("")), F.nullif(F.trim(N.text("decision_no")), F.lit("")))
    rows = both.withColumn("key", key).where(F.col("key").isNotNull())
    first = rows.groupBy(id, "key").agg(F.min(F.struct("_from", "ref_ix", "_part", "court", "city", "decision_no", "date", "file_no")).alias("r"))
    return first.select(id, "key", "r.court", "r.city", "r.decision_no", "r.date", "r.file_no")
