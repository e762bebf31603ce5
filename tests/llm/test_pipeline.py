"""The stages on a small corpus, and the whole pipeline on the smallest tables."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_every_stage_takes_effect_and_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    junk = spark.createDataFrame([(10_001, "1234 -- 5678", "en", "s", 12), (10_002, None, None, None, None)], docs.schema)
    copy = docs.where("doc_id = 3").withColumn("doc_id", F.lit(10_003).cast("long"))
    docs = docs.unionByName(junk).unionByName(copy)
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names, name
        path = corpus_pipeline._shared.scratch(spark, "test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= kept, name
        if name == "language ID":
            assert kept - now == {10_001, 10_002}
        if name == "n-gram Jaccard join":
            assert 10_003 not in now and len(now) > 0.8 * len(kept)
        kept = now
    mixed = corpus_pipeline.mix_to_targets(spark, docs, SF)
    assert mixed.count() == len(kept) and set(names) <= set(mixed.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run_gives_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and out.where("taken > 3 * size").count() == 0


def removed_bytes(rows, n=50):
    """Each text without the bytes of n-byte strings that also start in a smaller document."""
    first, out = {}, {}
    for id, t in rows:
        for p in range(len(t) - n + 1):
            first[t[p : p + n]] = min(first.get(t[p : p + n], id), id)
    for id, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - n + 1):
            if first[t[p : p + n]] < id:
                gone[p : p + n] = [True] * n
        out[id] = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else t.decode()
    return out


def without_windows(text, items, n=10):
    """A text without the words of the items' windows and what stands in front of each; None if too little is left."""
    words = list(re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", text))
    wanted = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", item.lower()) for item in items]
    windows = {tuple(w[i : i + n]) for w in wanted for i in range(len(w) - n + 1)}
    low = [w.group().lower() for w in words]
    gone = {j for i in range(len(low) - n + 1) if tuple(low[i : i + n]) in windows for j in range(i, i + n)}
    if not gone:
        return text
    if len(gone) >= 0.8 * len(words):
        return None
    ends = [0, *(w.end() for w in words)]
    return "".join(text[ends[i] : w.end()] for i, w in enumerate(words) if i not in gone) + text[ends[-1] :]


def test_the_whole_pipeline_against_plain_versions(spark, tmp_path):
    """Copies, near copies, a shared passage, a benchmark passage, junk, nulls, repeated rows, clashing and extra columns."""
    rng = np.random.default_rng(6)
    lexicon = {lang: ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(300)] for lang in ("en", "fr")}
    prose = lambda lang, n: " ".join(rng.choice(lexicon[lang], n))
    passage, item, other = prose("en", 30), " ".join(f"item{i}" for i in range(25)), " ".join(f"other{i}" for i in range(25))
    texts = [(prose(lang, 60), lang) for lang in ("en", "fr") for _ in range(12)]
    texts += [(texts[0][0], "en"), (texts[1][0] + " tail", "en"), (prose("en", 20) + " " + passage, "en"), (passage + " " + prose("en", 20), "en"), (prose("fr", 40) + ". " + item + ", " + prose("fr", 10), "fr"), (other + " x", "en")]
    texts += [("1234 !!", None), (None, None), ("", "en"), ("".join(chr(0x4E00 + x) for x in rng.integers(0, 5000, 200)), None)]
    rows = [(i, t, lang, None if i % 9 == 0 else f"s{i % 3}", len(t or ""), f"r{i}") for i, (t, lang) in enumerate(texts)]
    rows += [rows[2], (None, texts[3][0], "en", "s1", 1, "n1"), (None, prose("fr", 50), "fr", "s1", 1, "n2")]
    shape = "doc_id long, text string, lang string, source string, n_chars long, row string"
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", item), ("c", other)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["row"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # a learned language, one of each group of near copies, then passages, then benchmark windows
    left = {r[5]: (r[0], r[1]) for r in rows if r[1] and re.search("[A-Za-z]", r[1])}
    sets = {k: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} for k, (_, t) in left.items()}
    order = {k: id if id is not None else 10**6 + i for i, (k, (id, _)) in enumerate(left.items())}
    left = {k: v for k, v in left.items() if not any(order[o] < order[k] and 100 * len(sets[o] & sets[k]) >= 80 * len(sets[o] | sets[k]) for o in left)}
    assert "r24" not in left and "r25" not in left and "n1" not in left and "n2" in left
    kept = removed_bytes([(order[k], t.encode()) for k, (_, t) in left.items()])
    want = {k: without_windows(kept[order[k]], [item, other]) for k in left if kept[order[k]].strip()}
    want = {k: t for k, t in want.items() if t is not None}
    assert {k: r.text for k, r in got.items()} == want and "r29" not in got
    assert all(r.n_chars == len(r.text) and 0 <= r.taken <= 3 * r.size for r in got.values())
    total = {}
    for r in got.values():
        total.setdefault(r.source, []).append(r.taken - r.rate * r.size)
    assert len(total) == 4 and all(abs(sum(x)) <= max(r.size for r in got.values()) for x in total.values())


def test_every_stage_takes_empty_tables_and_clashing_names(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long, id string, all string, h string, component_id string, spans string, bits_per_byte string"
    docs = [(1, "one two three four five six", "en", "s", 27, *"abcdef"), (2, None, None, None, None, *"ghijkl"), (2, None, None, None, None, *"ghijkl")]
    spark.createDataFrame([("b", "never seen words")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, []):
        df = spark.createDataFrame(rows, shape)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            assert set(df.columns) <= set(out.columns), name
            found = [tuple(r) for r in out.select(df.columns).collect()]
            assert set(found) <= set(rows) and len(found) == (0 if not rows else {"language ID": 1, "n-gram Jaccard join": 2}.get(name, 3)), name


def test_near_copies_of_ids_that_repeat(spark):
    """Ids 1, 5, 5 and 7: a row of id 5 equals document 1, the other row of id 5 and document 7 are near copies of one another."""
    words = [f"w{i}" for i in range(60)]
    one, two = " ".join(words), " ".join(words[::-1])
    rows = [(1, one, "a"), (5, one, "b"), (5, two, "c"), (5, two, "d"), (7, two + " tail", "e"), (None, one, "f"), (None, "another text without a partner", "g")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in order], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        assert sorted(r.source for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == ["a", "c", "g"]


def test_passages_keep_columns_called_as_what_is_added(spark):
    text = "a passage that is long enough to be removed as a copy of another one"
    shape = "doc_id long, text string, n_chars long, n_removed long, n_units long, n_spans string, kept_sha256 string"
    docs = spark.createDataFrame([(1, text + " first", 1, 7, 8, "x", "y"), (2, "second " + text, 1, 9, 10, "z", None)], shape)
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()}
    assert [tuple(got[i])[3:] for i in (1, 2)] == [(7, 8, "x", "y"), (9, 10, "z", None)]
    assert got[1].text == text + " first" and got[2].text == "second " and got[2].n_chars == 7
