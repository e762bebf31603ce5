"""Lists of known values found by an automaton against the same values looked for one by one."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import known_values as K
from docloom.functions import pii as P
from docloom.operators import routing as R

LETTERS = "ابتمحديعلىأإنروسكو"


def name(rng):
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 3))]
    return " ".join([rng.choice(["السيد", "الأستاذة"])] * (rng.random() < 0.2) + words)


def written(rng, value):
    """A value as a text may have it: marks, tatweel, spaces and page breaks between letters, turned words."""
    if rng.random() < 0.3:
        value = " ".join(value.split()[::-1])
    return "".join(c + rng.choice(["", "", "", "ـ", "َ", "\n", " "]) * (rng.random() < 0.2) for c in value)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    values = [name(rng) for _ in range(60)] + ["Ali", "ع ح", "", "  ", None, "Ann Lee", "x", "محمد", "محمد العلوي"]
    texts = [" ".join(written(rng, rng.choice(values) or "نص") if rng.random() < 0.4 else name(rng) for _ in range(rng.randint(1, 25))) for _ in range(120)]
    texts += [None, "", "Ali Annealing", "AnnLee", "Lee\fAnn", "محـمدالعلوي"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return docs, values, spark.createDataFrame([(v,) for v in values], "value string")


def test_gate_finds_what_a_scan_value_by_value_finds(case):
    docs, values, table = case
    known = K.prepare(table)
    both = docs.select("doc_id", K.leak_scan_known("text", known).alias("a"), P.leak_scan("text", F.array(*[F.lit(v) for v in values if v])).alias("b")).collect()
    assert sum(len(r.a.leaked) for r in both) > 200
    assert [r.a for r in both] == [r.b for r in both]


def test_redactor_does_what_it_does_value_by_value(case):
    docs, values, table = case
    known = K.prepare(table)
    both = docs.select("doc_id", K.redact_known("text", known).alias("a"), P.redact_names("text", F.array(*[F.lit(v) for v in values if v])).alias("b")).collect()
    assert sum(r.a.hits for r in both) > 200
    for r in both:
        assert (r.a.text, sorted(r.a.replaced), r.a.hits) == (r.b.text, sorted(r.b.replaced), r.b.hits)


def test_values_in_blocks(case, monkeypatch):
    docs, _, table = case
    whole = sorted(map(str, R.known_value_leaks(docs, table).collect()))
    clean = R.redact_known_values(docs, table)
    assert clean.where("hits > 0").count() > 60 and clean.columns == ["doc_id", "text", "replaced", "hits"]
    monkeypatch.setattr(R, "LEAK_VALUES", 9)
    assert sorted(map(str, R.known_value_leaks(docs, table).collect())) == whole
    # what the redactor leaves passes the gate, in one block or in several
    for cleaned in (clean, R.redact_known_values(docs, table)):
        assert R.known_value_leaks(cleaned.select("doc_id", "text"), table).where("not passed").where(F.exists("leaked", lambda v: F.length(P.significant(v)) <= P.SHORT)).count() == 0


def test_no_values_and_no_documents(case):
    docs, _, table = case
    assert R.known_value_leaks(docs, table.limit(0)).where("passed").count() == docs.count()
    assert R.known_value_leaks(docs.limit(0), table).count() == 0
    assert R.redact_known_values(docs.limit(0), table).count() == 0


def test_many_values_need_one_pass(spark, case):
    """Ten thousand values that no text holds leave no work for the patterns."""
    rng = random.Random(5)
    docs, _, table = case
    many = table.union(spark.createDataFrame([(f"{name(rng)} {name(rng)} {i}",) for i in range(10_000)], "value string"))
    assert sorted(map(str, R.known_value_leaks(docs, many).collect())) == sorted(map(str, R.known_value_leaks(docs, table).collect()))


def test_literal_leaks_are_those_a_text_holds_as_written(spark, case, monkeypatch):
    """A value with spaces between its letters, or with the letters of two words, is found by the gate but is not literal."""
    docs = spark.createDataFrame([(1, "does bo"), (2, "a Thanth b"), (3, "Than th Thanthem"), (4, None), (5, "")], "doc_id long, text string")
    table = spark.createDataFrame([("doesbo",), ("Thanth",), ("Thanth",), (None,)], "value string")
    for block in (50_000, 1):
        monkeypatch.setattr(R, "LEAK_VALUES", block)
        got = {r.doc_id: (r.passed, r.leaked) for r in R.literal_value_leaks(docs, table).collect()}
        assert got == {1: (True, []), 2: (False, ["Thanth"]), 3: (False, ["Thanth"]), 4: (True, []), 5: (True, [])}
    assert not {r.doc_id: r.passed for r in R.known_value_leaks(docs, table).collect()}[1]


def test_counts_by_letters_are_counts_by_pattern(spark):
    """Long values are counted without patterns: repeats that overlap, letter variants, marks and white space of any script."""
    texts = ["abababab ababab", "a b\u2003a\u00a0b a", "أحمَد  ا\u0640حمد احمدي", "ababa" * 300, "(ax.by+z) ax.by+z", "على علي وعلى معلى"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    values = ["ababa", "أحمد السيد", "ax.by+z", "احمدي", "علي", "السيد احمد"]
    r = docs.select("doc_id", "text", P.leak_scan("text", F.array(*[F.lit(v) for v in values])).alias("r"))
    n = lambda v: F.size(F.regexp_extract_all("text", F.concat(F.lit("(?U)("), P.name_pattern(F.lit(v)), F.lit(")")), F.lit(1)))
    for row in r.select("doc_id", "r.hits", *[n(v).alias(f"n{i}") for i, v in enumerate(["ababa", "ax.by+z", "احمدي", "علي"])], n("احمد").alias("n4")).collect():
        assert row.hits == sum(row[f"n{i}"] for i in range(5)), row


def test_scans_do_not_stay_in_the_task_that_reads_the_texts(spark, case):
    """A file of one row group is read by one task."""
    docs, _, table = case
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(was, ("false", "4"), strict=True):
            spark.conf.set(c, v)
        for scan in (R.known_value_leaks, R.literal_value_leaks):
            few = scan(docs.coalesce(1), table).select("doc_id", F.spark_partition_id().alias("task"))
            assert few.select("task").distinct().count() == 4 and few.count() == docs.count()
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
