"""Links and cases kept in step against full runs; versions of tables and their writers."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import linkage as L
from docloom.operators import relinking as R
from docloom.operators.components import stored
from docloom.sources.snapshots import SnapshotStore, StaleParent
from docloom.streaming.ingest import ingest_and_link

DOC = "doc_id string, level string, court string, city string, decision_no string, date string, file_no string"
REF = "doc_id string, ref_ix int, court string, city string, decision_no string, date string, file_no string"
LEVELS = ["ابتدائي", "استئناف", "نقض", ""]
COURTS = ["المحكمة الابتدائية بفاس", "محكمة الاستئناف بفاس", "محكمة النقض", ""]


def ruling(rng, i):
    """A document of few keys, so that many meet, and its references."""
    lv = rng.randrange(4)
    own = lambda: (COURTS[rng.randrange(4)], rng.choice(["فاس", "طنجة", ""]), str(rng.randrange(4)) if rng.random() < 0.8 else "", f"0{rng.randrange(1, 4)}/03/2016", f"{rng.randrange(25)}/1/2014" if rng.random() < 0.7 else "")
    return (f"d{i}", LEVELS[lv], *own()), [(f"d{i}", k, *own()) for k in range(rng.randrange(3))]


def frames(spark, rulings):
    docs = spark.createDataFrame([d for d, _ in rulings], DOC)
    return docs, spark.createDataFrame([r for _, refs in rulings for r in refs], REF)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def same(a, b):
    for table, columns in (("docs", ["doc_id", "file_no"]), ("refs", ["doc_id", "ref_ix", "file_no"]), ("edges", ["parent_doc", "ref_ix", "child_doc", "confidence", "score"]), ("cases", ["doc_id", "component", "case_id", "review"])):
        assert rows(a[table], *columns) == rows(b[table], *columns), table


def test_any_batches_equal_one_full_run(spark):
    """New, replaced and removed documents in batches drawn at random, some of them of unknown ids."""
    rng = random.Random(1)
    state, live = R.empty_state(*frames(spark, [])), {}
    for step in range(4):
        put = {i: ruling(rng, i) for i in rng.sample(range(60), 30 if not step else 9)}
        removed = [] if not step else [f"d{i}" for i in rng.sample(range(60), 6) if i not in put] + ["never"]
        docs, refs = frames(spark, list(put.values()))
        state = R.apply_batch(state, docs, refs, spark.createDataFrame([(r,) for r in removed], "doc_id string"), 2026)
        state = {k: v.checkpoint() for k, v in state.items()}
        live = {k: v for k, v in (live | put).items() if f"d{k}" not in removed or k in put}
        if step == 3:
            same(state, R.full_state(*frames(spark, list(live.values())), 2026))
    assert state["edges"].count() > 5
    gone = R.apply_batch(state, *frames(spark, []), state["docs"].select("doc_id"), 2026)
    assert all(df.isEmpty() for df in gone.values())


def test_a_component_falls_apart_and_grows_together(spark):
    first = (("a", "ابتدائي", COURTS[0], "فاس", "1", "01/03/2015", "8/1/2014"), [])
    middle = (("b", "استئناف", COURTS[1], "فاس", "2", "01/03/2016", "9/1/2015"), [("b", 0, *first[0][2:])])
    last = (("c", "نقض", COURTS[2], "فاس", "3", "01/03/2017", "7/1/2016"), [("c", 0, *middle[0][2:])])
    none = spark.createDataFrame([], "doc_id string")
    cases = lambda s: {r.doc_id: r.case_id for r in s["cases"].collect()}
    for order in ([last, middle, first], [middle, last, first]):
        state = R.empty_state(*frames(spark, []))
        for one in order:
            state = {k: v.checkpoint() for k, v in R.apply_batch(state, *frames(spark, [one]), none, 2026).items()}
        assert cases(state) == dict.fromkeys("abc", "C:8/1/2014")
    apart = R.apply_batch(state, *frames(spark, []), spark.createDataFrame([("b",)], "doc_id string"), 2026)
    assert cases(apart) == {"a": "C:8/1/2014", "c": "C:7/1/2016"} and apart["edges"].isEmpty()


def test_files_of_rulings_are_linked_in_any_runs(spark, tmp_path):
    """Two feeds of the same rulings in other files and orders: a copy, a change and a removal; a batch is run again."""
    base = {"level": "", "court": "", "city": "فاس", "decision_no": "", "date": "", "file_no": "", "refs": []}
    ref = {"court": "", "city": "فاس", "decision_no": "", "date": "", "file_no": "8/1/2014"}
    made = [{"doc_id": "a", "seq": 1, "text": "one", "file_no": "8/1/2014"}, {"doc_id": "b", "seq": 2, "text": "two", "refs": [ref]}, {"doc_id": "c", "seq": 3, "text": "one"}, {"doc_id": "d", "seq": 4, "text": "four", "file_no": "5/1/2014"}, {"doc_id": "e", "seq": 5, "text": "five", "refs": [ref]}, {"doc_id": "d", "seq": 6, "text": "four again", "refs": [ref]}, {"doc_id": "e", "seq": 7, "removed": True}]
    results = []
    for name, runs in (("x", [made]), ("y", [made[:2], made[2:5], made[5:]])):
        for i, part in enumerate(runs):
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"{i}.json").write_text("\n".join(json.dumps(base | r) for r in part))
            ingest_and_link(spark, str(tmp_path / name), str(tmp_path / f"{name}-store"), str(tmp_path / f"{name}-cp"), 2026)
        store = SnapshotStore(spark, str(tmp_path / f"{name}-store"))
        results.append([rows(store.read("docs"), "doc_id", "text"), rows(store.read("edges"), "parent_doc", "child_doc"), rows(store.read("cases"), "doc_id", "case_id")])
        newest = store.version().number
        ingest_and_link(spark, str(tmp_path / name), str(tmp_path / f"{name}-store"), str(tmp_path / f"{name}-cp-lost"), 2026)
        assert rows(store.read("cases"), "doc_id", "case_id") == results[-1][2] and store.version().number == newest
    assert results[0] == results[1]
    assert results[0][0] == [("a", "one"), ("b", "two"), ("d", "four again")] and results[0][1] == [("b", "a"), ("d", "a")]


def test_readers_see_whole_versions_only(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.version().number == 0 and store.tables() == {}
    ids = spark.range(5).toDF("id")
    store.commit({"a": ids, "b": ids.where("id < 2")}, 0, {"by": "first"})
    # a writer that dies before it publishes leaves files, but no version
    ids.write.parquet(str(tmp_path / "s/data/a-unfinished"))
    (tmp_path / "s/_drafts").mkdir(exist_ok=True)
    (tmp_path / "s/_drafts/half").write_text('{"tab')
    assert store.version().number == 1 and store.read("a").count() == 5
    # an empty table counts, the other table and the notes stay
    store.commit({"a": ids.where("false")}, 1)
    assert store.read("a").count() == 0 and store.read("a").columns == ["id"] and store.read("b").count() == 2
    assert store.version().notes == {"by": "first"} and store.read("a", 1).count() == 5


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    store, other = (SnapshotStore(spark, str(tmp_path / "s")) for _ in range(2))
    ids = spark.range(5).toDF("id")
    store.commit({"a": ids}, 0)
    parent = other.version()
    store.commit({"a": ids.where("id < 4")}, 1)
    with pytest.raises(StaleParent):
        other.commit({"a": ids.where("id < 3")}, parent.number)
    # one that passes the first check too late is stopped by the rename
    other._refuse = lambda parent: None
    with pytest.raises(StaleParent):
        other.commit({"a": ids.where("id < 3")}, 1)
    assert store.read("a").count() == 4 and len(list((tmp_path / "s/data").iterdir())) == 2
    seen = []

    def change(version, tables):
        if not seen:
            store.commit({"a": ids.where("id < 2")}, version.number)
        seen.append(version.number)
        return {"a": tables["a"].withColumn("id", F.col("id") + 10)}

    del other._refuse
    assert other.update(change).number == 4 and seen == [2, 3]
    assert rows(store.read("a"), "id") == [(10,), (11,)]
    assert store.vacuum(keep=1) == 3 and store.versions() == [4] and store.read("a").count() == 2


@pytest.mark.parametrize("dense", [0, 6])
def test_dense_keys_give_the_links_of_all_pairs(spark, monkeypatch, dense):
    rng = random.Random(9)
    docs, refs = frames(spark, [ruling(rng, i) for i in range(150)])
    want = L.best_link(L.match_score(L.rank_filter(L.link_candidates(docs, refs, 2026), docs)), "ref_ix")
    monkeypatch.setattr(L, "DENSE", dense)
    columns = ["parent_doc", "ref_ix", "child_doc", "confidence", "score"]
    assert rows(L.relink(docs, refs, 2026, "ref_ix"), *columns) == rows(want, *columns) and want.count() > 40


def test_one_key_of_a_hundred_thousand_documents_and_references(spark):
    """Pair by pair these would be 2.5 billion."""
    docs = spark.range(100_000).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("doc_id"), F.element_at(F.array(*[F.lit(x) for x in LEVELS[:2]]), (F.col("id") % 2 + 1).cast("int")).alias("level"), F.lit("").alias("court"), F.concat(F.lit("c"), F.floor(F.col("id") / 2) % 500).alias("city"), F.col("id").cast("string").alias("decision_no"), F.lit("01/03/2016").alias("date"), F.lit("8/1/2014").alias("file_no"))
    refs = docs.where("level = 'استئناف'").select("doc_id", F.lit(0).alias("ref_ix"), "court", "city", F.when(F.crc32("doc_id") % 2 == 0, "4000").otherwise("none").alias("decision_no"), "date", "file_no")
    links = L.relink(docs, refs, 2026)
    by = {(r.child_doc[:2], r.confidence, r.score): r.n for r in links.groupBy(F.substring("child_doc", 1, 2).alias("child_doc"), "confidence", "score").agg(F.count("*").alias("n")).collect()}
    assert sum(by.values()) == 50_000 and {k[1:] for k in by} == {("high", 7), ("medium", 6), ("high", 5)}
    named = refs.where("decision_no = '4000'").count()
    assert links.where("child_doc = 'd004000'").count() == named


@pytest.mark.parametrize("dense", [0, 3, 100])
def test_links_by_parts_of_a_file_number(spark, monkeypatch, dense):
    """File numbers of the same parts in another order, against the best pair picked row by row."""
    rng = random.Random(4)
    own = lambda: (COURTS[rng.randrange(4)], rng.choice(["فاس", "طنجة", ""]), str(rng.randrange(3)), f"0{rng.randrange(1, 3)}/03/2016", rng.choice(["7/3/2014", "3/7/2014", "8/3/2014", "3/8/2014", ""]))
    docs = spark.createDataFrame([(f"d{i}", rng.choice(LEVELS), *own()) for i in range(60)], DOC)
    refs = spark.createDataFrame([(f"d{i}", k, *own()) for i in range(60) for k in range(rng.randrange(3))], REF)
    best = {}
    for r in L.match_score(L.rank_filter(L.link_candidates(docs, refs, 2026), docs)).where("confidence IN ('high', 'medium')").collect():
        at, link = (r.doc_id, r.ref_ix), (-r.score, r.child, r.confidence)
        best[at] = min(best.get(at, link), link)
    want = sorted((p, ix, child, confidence, -score) for (p, ix), (score, child, confidence) in best.items())
    monkeypatch.setattr(L, "DENSE", dense)
    assert rows(L.relink(docs, refs, 2026, "ref_ix"), "parent_doc", "ref_ix", "child_doc", "confidence", "score") == want
    assert len({(score, confidence) for *_, confidence, score in want}) >= 4


def test_a_batch_leaves_no_shuffles_behind(spark):
    """What a batch has shuffled is gone from the disk when its tables are written."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    held = lambda: {b.toString() for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.blockManager().diskBlockManager().getAllBlocks()) if b.isShuffle()}
    rng = random.Random(6)
    docs, refs = frames(spark, [ruling(rng, i) for i in range(80)])
    before = held()
    state = R.apply_batch(R.empty_state(docs, refs), docs, refs, docs.select("doc_id").limit(0), 2026)
    written = [stored(state[k]) for k in ("edges", "cases")]
    for _ in range(40):
        if not (left := held() - before):
            break
        time.sleep(0.25)
    assert not left and all(df.count() for df in written)
