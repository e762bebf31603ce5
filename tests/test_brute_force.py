"""Queries that SQL does not express, and rules that it cannot follow, against plain versions over whole tables."""

import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import normalise as N
from docloom.functions import quality as Q
from docloom.operators import edits as E
from docloom.operators import routing as R
from docloom.plans import registry

WORDS = "الكراء the of حكم، a\tb XXXXXXX محكمة النقض 12/3".split(" ")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Conversations and documents with nulls, empty texts, names across turns, repeats and long paragraphs."""
    import numpy as np

    rng = np.random.default_rng(5)
    text = lambda n: " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))
    folder = str(tmp_path_factory.mktemp("tables"))
    turns = [(c, t, "user", None if (c, t) == (3, 1) else "" if (c, t) == (4, 0) else f"{['Amina', 'the', 'XY', 'محمد'][c % 4]} {text(12)} A m i n a") for c in range(12) for t in range(4)]
    docs = [(i, ("\n\n" if i % 2 else "\n").join(text(int(n)) for n in rng.integers(0, 90, 12)), "en", "s", 1) for i in range(30)] + [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, "x" * 5000, "en", "s", 0)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, turns, docs


def plain_redaction(pages, values):
    """Sequential replacement, longest value first, over pages joined by form feeds."""
    gap = "[\\sـً-ٰٟ]*"
    body, hits = "\f".join(t or "" for t in pages), 0
    for v in sorted({v for v in values if v and v.strip()}, key=lambda v: (-len(v), v)):
        letters = re.sub("[\\sـً-ٰٟ]", "", v)
        runs = [r for r in re.split(r"[\W_]+", v) if r]
        if len(letters) < 3 or runs and all(len(r) == 1 for r in runs):
            continue
        rx = gap.join(re.escape(x) for x in letters)
        if len(letters) <= 4:
            rx = f"(?:(?<![ء-ي])|(?<=(?<![ء-ي])[وفبلك]))(?:{rx})(?![ء-ي])"
        body, n = re.subn(rx, lambda m: "XXXXXXX" + "\f" * m.group().count("\f"), body)
        hits += n
    return body.split("\f"), hits


def test_redact_document(spark, tables):
    folder, turns, _ = tables
    got = {}
    for r in registry.QUERIES["redact_document"](spark, folder).collect():
        got.setdefault(r.doc_id, []).append((r.page_no, r.text, r.name_hits))
    by = {}
    for c, t, _, text in turns:
        by.setdefault(c, []).append((t, text))
    assert set(got) == set(by)
    for c, pages in by.items():
        want, hits = plain_redaction([x for _, x in sorted(pages)], [x.split(" ")[0] for _, x in pages if x])
        assert [x[1] for x in sorted(got[c])] == want and {x[2] for x in got[c]} == {hits}
    assert max(x[2] for pages in got.values() for x in pages) > 8


def test_chunk_text(spark, tables):
    folder, _, docs = tables
    got = {}
    for r in registry.QUERIES["chunk_text"](spark, folder).collect():
        got.setdefault(r.doc_id, {})[r.i] = r.n
    for id, text, *_ in docs:
        pieces = E.chunks(text or "", 1500)
        assert got.get(id, {}) == dict(enumerate(map(len, pieces)))
        assert "".join(pieces).split() == (text or "").split() and all(len(p) <= 1500 for p in pieces)
        # no piece could have held the paragraph that follows it
        for a, b in zip(pieces, pieces[1:], strict=False):
            assert len(a) + len(re.split(r"\n\s*\n", b.lstrip("\n"))[0]) > 1500 or "\n" not in a


def test_reflow_lines(spark, tables):
    folder, _, docs = tables
    df = registry.table(spark, folder, "documents")
    for r in df.select("doc_id", "text", N.reflow_lines("text").alias("p")).collect():
        want, open_ = [], False
        for line in (x.strip() for x in (r.text or "").split("\n")):
            header = len(line) <= N.HEADER_CHARS or (len(line) <= N.HEADER_CUE_CHARS and bool(re.search(N.HEADER_CUES, line)))
            if not line:
                open_ = False
            elif header:
                want.append((True, line))
                open_ = False
            elif open_:
                want[-1] = (False, f"{want[-1][1]} {line}")
            else:
                want.append((False, line))
                open_ = True
        assert [(p.header, p.text) for p in r.p] == want


def test_edits_put_together_give_both_texts(spark, tables):
    _, _, docs = tables
    texts = [t for _, t, *_ in docs if t and len(t) < 4000]
    for old, new in zip(texts, [*texts[1:], texts[0]], strict=True):
        changed = old.replace("the", "XXXXXXX")
        assert E.only_removes(old, changed) and E.only_removes(old, old) and E.only_removes(old, "")
        assert not E.only_removes(changed, old) or changed == old
        assert not E.only_removes(old, old + " zzz")
        for a, b in ((old, new), (old, changed), (old, "new " + old), (old, old[len(old) // 3 :])):
            both = E.aligned(a, b)
            assert "".join("".join(x) for x, _ in both) == a and "".join("".join(y) for _, y in both) == b
            for h in E.hunks(a, b):
                gone = "".join(s["text"] for s in h["segments"] if s["op"] == "del")
                assert gone in a or " … " in gone or len([s for s in h["segments"] if s["op"] == "del"]) > 1
                assert 1 <= h["line"] <= a.count("\n") + 1


def test_budget_cutoff_with_wide_rows_and_small_ranges(spark):
    """Ranges that are drawn anew for other columns must not change what is within the budget."""
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(60_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("seq"), F.lit(1).alias("cost"), F.repeat(F.lit("x"), F.lit(300)).alias("payload"))
        got = R.budget_cutoff(rows, 20_000)
        assert got.count() == 20_000 and got.agg(F.max("seq")).first()[0] <= rows.orderBy("seq").limit(20_001).agg(F.max("seq")).first()[0]
        uneven = spark.createDataFrame([(None, 2.0), (1, 3.0), (1, 1.0), (2, 5.0), (3, 1.0), (4, None)], "seq int, cost double")
        assert sorted(str(tuple(r)) for r in R.budget_cutoff(uneven, 6.5).collect()) == ["(1, 1.0)", "(1, 3.0)", "(2, 5.0)", "(None, 2.0)"]
        assert R.budget_cutoff(uneven, 3.0).count() == 2 and R.budget_cutoff(uneven, 0.0).count() == 0 and R.budget_cutoff(uneven.limit(0), 5.0).count() == 0
        assert R.budget_cutoff(uneven, 99.0).count() == 6
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def test_known_values_in_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a bench mark text"), (2, "محمـد here"), (3, "clean"), (4, None)], "doc_id long, text string")
    values = spark.createDataFrame([("benchmark",), ("محمد",), ("nothing",), (None,), ("text",)], "value string")
    whole = sorted(map(str, R.known_value_leaks(docs, values).collect()))
    monkeypatch.setattr(R, "LEAK_VALUES", 1)
    assert sorted(map(str, R.known_value_leaks(docs, values).collect())) == whole
    assert sum("passed=False" in x for x in whole) == 2


def test_the_release_gate_holds_leaks_back(spark, tmp_path):
    """A name that only the gate finds, a garbled text and a short one are held; a copy is dropped."""
    name, arabic = "محمد العلوي", " قضت المحكمة" * 30
    texts = [arabic, arabic, arabic + " مح" + "ؐ" + "مد العلوي", "latin words " * 40, "short", arabic + name]
    monkey = dict(registry.VIEWS)
    registry.VIEWS["scans"] = "SELECT doc_id, md5(text) AS hash, source, text FROM {documents}"
    try:
        spark.createDataFrame([(i + 1, t, "ar", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        r = registry.QUERIES["delivery_by_source"](spark, str(tmp_path)).first()
    finally:
        registry.VIEWS.update(monkey)
    assert (r.documents, r.delivered, r.held_leak, r.held_poor_ocr, r.held_empty, r.removed) == (5, 2, 1, 1, 1, 1)
    assert Q.LEAST == 200
