"""Jobs on small tables: linkage in any order of arrival, copies, edits, replies, search, streams."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.functions import pii as P
from docloom.operators import catalogue as C
from docloom.operators import dedupe as D
from docloom.operators import edits as E
from docloom.operators import linkage as L
from docloom.operators import routing as R
from docloom.operators import search as S
from docloom.operators import subjects as J
from docloom.operators.components import connected_components
from docloom.plans import registry
from docloom.sources import files, replies
from docloom.streaming.ingest import incremental_ingest

DOC = "doc_id string, level string, court string, city string, decision_no string, date string, file_no string, category string"
REF = "doc_id string, ref_ix int, court string, city string, decision_no string, date string, file_no string"
DOCS = [
    ("ibtidai_12345", "ابتدائي", "المحكمة الابتدائية", "فاس", "12345", "15/10/2015", "8888/1/2014", "مدنية"),
    ("istinaf_1990", "استئناف", "محكمة الاستئناف", "فاس", "1990", "08/03/2016", "4443/8202/2015", ""),
    ("naqd_589-3", "نقض", "محكمة النقض", "الرباط", "589-3", "26-11-2019", "1537-3-3-2016", "مدنية"),
    ("alone", "", "", "", "", "", "", ""),
]
REFS = [("istinaf_1990", 0, "المحكمة الابتدائية", "فاس", "", "", "8888/1/2014"), ("naqd_589-3", 0, "محكمة الاستئناف", "فاس", "1990", "", "4443-8202-2015")]


@pytest.mark.parametrize("order", [1, -1])
def test_linking_does_not_depend_on_order(spark, order):
    docs, refs = spark.createDataFrame(DOCS[::order], DOC).repartition(2), spark.createDataFrame(REFS[::order], REF)
    edges = L.relink(docs, refs, 2026)
    assert sorted((r.parent_doc, r.child_doc) for r in edges.collect()) == [("istinaf_1990", "ibtidai_12345"), ("naqd_589-3", "istinaf_1990")]
    cases = {r.doc_id: r.case_id for r in L.connected_cases(docs, edges, 2026).collect()}
    assert cases == {"ibtidai_12345": "C:8888/1/2014", "istinaf_1990": "C:8888/1/2014", "naqd_589-3": "C:8888/1/2014", "alone": "C:alone"}
    summary = {r.case_id: r for r in L.case_summary(docs.join(L.connected_cases(docs, edges, 2026), "doc_id"), refs).collect()}
    one = summary["C:8888/1/2014"]
    assert one.levels_present == "ابتدائي، استئناف، نقض" and one.missing_levels == "" and one.cassated == "نعم" and one.naqd_file == "1537-3-3-2016"


def test_open_reports_cap_all_reads_all_reports(spark, tmp_path):
    """New and stored reports of any id count; test_entry leaves out names that begin with op."""
    rows = [(i, 7, "a", f"2024-01-{1 if i < 40 else 2:02d} 00:00:{i:02d}", 1.0) for i in range(42)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    stored = registry.view(spark, str(tmp_path), "reports").where("status = 'open' AND report_id < 40").count()
    got = {r.report_id: r.accepted for r in registry.QUERIES["open_reports_cap_all"](spark, str(tmp_path)).collect()}
    assert got == {40: stored + 1 <= 20, 41: stored + 2 <= 20}


def test_leak_scan_finds_spaced_and_short_values(spark, tmp_path):
    """What SQL's contains cannot follow: spaces between letters, marks, short names as whole words."""
    docs = [(1, "a bench mark text"), (2, "benchmark"), (3, "clean"), (4, "محمـد"), (5, "an Ali b"), (6, "b e n c h m a r k")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "benchmark one"), (2, "محمد x"), (3, "Ali y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: {r.doc_id: r.leaked for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("leak_scan") == {1: "benchmark", 2: "benchmark", 3: "", 4: "", 5: "", 6: "benchmark"}
    assert run("leak_scan_all") == {1: "benchmark", 2: "benchmark", 3: "", 4: "محمد", 5: "Ali", 6: "benchmark"}


def test_linking_stays_linear(spark):
    n = 300
    docs = [(f"{k}{i}", lv, "", "", "", "", f"{b + i}/1/2/{y}", "") for i in range(n) for k, lv, b, y in (("a", "ابتدائي", 1000, 2015), ("b", "استئناف", 2000, 2017), ("c", "نقض", 3000, 2019))]
    refs = [(f"b{i}", 0, "", "", "", "", f"{1000 + i}/1/2/2015") for i in range(n)] + [(f"c{i}", 0, "", "", "", "", f"{2000 + i}/1/2/2017") for i in range(n)]
    d, r = spark.createDataFrame(docs, DOC), spark.createDataFrame(refs, REF)
    assert L.link_candidates(d, r, 2026).count() == 2 * n
    edges = L.relink(d, r, 2026)
    assert edges.count() == 2 * n and L.connected_cases(d, edges, 2026).select("case_id").distinct().count() == n


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (103, 103), (None, 5), (101, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def _labels(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def test_stars_take_few_rounds(spark):
    """Hubs, of the smallest and of the largest number, a shuffled chain, a tree and sparse random edges, against union-find."""
    import random

    rand = random.Random(3)
    names = list(range(1000))
    rand.shuffle(names)
    shapes = {
        "hub": ([(0, i) for i in range(1, 3000)], 1),
        "large hub": ([(3000, i) for i in range(3000)], 2),
        "chain": (list(zip(names, names[1:], strict=False)), 10),
        "tree": ([(names[i], names[i // 3]) for i in range(1, 1000)], 8),
        "random": ([(rand.randrange(2000), rand.randrange(2000)) for _ in range(1100)], 8),
    }
    for shape, (pairs, rounds) in shapes.items():
        pairs = [p for p in pairs if p[0] != p[1]]
        rows = connected_components(spark.createDataFrame(pairs, "a long, b long"), rounds=rounds).collect()
        assert len(rows) == len({r.node for r in rows})
        assert {r.node: r.component for r in rows} == _labels(pairs), shape
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(shapes["chain"][0], "a long, b long"), rounds=1)


def test_chains_whose_edges_come_together_need_no_rounds(spark):
    """As the edges of a customer's successive orders: in order, and each chain in one task; with repeats, loops and nulls."""
    chains = [[(100 * c + i, 100 * c + i + 1) for i in range(40)] for c in range(50)]
    pairs = [p for c in chains for p in c] + [(7, 7), (None, 3), (0, 1), (1, 0)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long").coalesce(1), rounds=1).collect()}
    assert got == {100 * c + i: 100 * c for c in range(50) for i in range(41)}


def test_which_copy_is_kept(spark):
    docs = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h2"), ("d", "h2"), ("e", "h3"), ("f", "h4"), ("g", "h4")], "doc_id string, hash string")
    known = spark.createDataFrame([("h1", "elsewhere"), ("h2", "d")], "hash string, doc_id string")
    done = spark.createDataFrame([("g",)], "doc_id string")
    got = {r.doc_id: (r.original, r.is_copy) for r in D.split_copies(docs, known, done).collect()}
    assert got == {"a": ("elsewhere", True), "b": ("elsewhere", True), "c": ("d", True), "d": ("d", False), "e": ("e", False), "f": ("g", True), "g": ("g", False)}


def test_edits(spark):
    T = P.TOKEN
    pairs = [("حضر محمد،", f"حضر {T}،", True), (f"حضر {T}", "حضر محمد", False), ("a b", "a b c", False), ("a\nb", "a", True), ("a", "a", True)]
    assert [E.only_removes(a, b) for a, b, _ in pairs] == [w for _, _, w in pairs]
    assert E.summary("a محمد b", f"a {T} b") == "1 hidden" and E.summary("a", "b").endswith("change(s)")
    assert [s["op"] for s in E.hunks("a b c", "a x c")[0]["segments"]] == ["equal", "del", "ins", "equal"]
    d = spark.createDataFrame([("d", 0, "نص محمد", "", None, ""), ("e", 3, "نص", "", None, "")], "doc_id string, version int, body_text string, search_text string, edited_at timestamp, edited_by string")
    rows = [(1, "d", 0, f"نص {T}", "x", "2024-01-01"), (2, "d", 0, f"{T} محمد", "y", "2024-01-02"), (3, "e", 2, "نص", "x", "2024-01-01"), (4, "e", 3, "نص زائد", "x", "2024-01-01"), (5, "e", 3, "نص a@b.com", "x", "2024-01-01")]
    edits = spark.createDataFrame(rows, "edit_id int, doc_id string, base_version int, new_text string, actor string, ts string").withColumn("ts", F.to_timestamp("ts"))
    out, versions, judged = E.apply_edit_batch(d, edits)
    assert {r.edit_id: r.outcome for r in judged.collect()} == {1: "applied", 2: "conflict", 3: "conflict", 4: "draft", 5: "refused"}
    assert {(r.doc_id, r.version, r.status) for r in versions.collect()} == {("d", 1, "applied"), ("d", 2, "applied"), ("e", None, "draft")}
    assert {r.doc_id: r.version for r in out.collect()} == {"d": 2, "e": 3}
    assert E.chunks("a" * 5 + "\n\n" + "b" * 5, 8) == ["aaaaa\n\n", "bbbbb"] and "".join(E.chunks("x\n" * 50, 11)) == "x\n" * 50


def test_replies(spark):
    good = '{"pages":["p"],"pii":[{"text":"a","type":"n"},{"text":"","type":"n"}],"court":null,"refs":[{"court":"c"},{"file_no":"1/2"}]}'
    cases = {good: "", f"```json\n{good}\n```": "", f"here it is {good} done": "", '[{"text":"a","type":"n"}]': "", '{"pii":[{"text":"a "b" c","type":"n"}]}': "", '{"pii":[{"text":"a': "unusable reply", "": "unusable reply", "no": "unusable reply"}
    got = replies.read_replies(spark.createDataFrame([(k, k) for k in cases], "id string, reply string"), ["id"]).withColumn("c", replies.clean_reply_rows(F.col("result"))).collect()
    assert {r.id: r.error for r in got} == cases
    by = {r.id: r for r in got}
    assert [p.text for p in by[good].c.pii] == ["a"] and [x.file_no for x in by[good].c.refs] == ["1/2"] and by[good].c.court == ""
    assert by['{"pii":[{"text":"a "b" c","type":"n"}]}'].c.pii[0].text == 'a "b" c'


def test_upsert_keeps_hand_edits(spark):
    shape = "doc_id string, state string, edited_at string, decision_date string, decision_no string, body_text string, search_text string, sort_key string, theme string"
    stored = spark.createDataFrame([("a", "published", None, "01/01/2020", "1", "x", "x", "k", "t"), ("b", "published", "2024", "01/01/2020", "1", "mine", "mine", "k", "t"), ("c", "withdrawn", None, "", "", "x", "x", "k", "t")], shape)
    new = spark.createDataFrame([("a", "02/02/2021", "7", "نص أ"), ("b", "02/02/2021", "7", "نص"), ("n", "02/02/2021", "7", "نص")], "doc_id string, decision_date string, decision_no string, body_text string")
    got = {r.doc_id: r for r in C.upsert_decisions(stored, new).collect()}
    assert [(got[k].state, got[k].body_text) for k in "abcn"] == [("under_review", "نص أ"), ("published", "mine"), ("withdrawn", "x"), ("imported", "نص")]
    assert got["a"].sort_key == "20210202000007" and got["a"].search_text == "نص ا" and got["a"].theme == "t"
    assert {r.state for r in C.upsert_decisions(stored, new, publish=True).where("doc_id = 'a'").collect()} == {"published"}


def test_search_forms(spark):
    d = spark.createDataFrame([("a", "طلب التعويض عن الضرر", "5"), ("b", "تعويضات الاداريه", "42"), ("c", "شيء اخر", "7")], "doc_id string, search_text string, decision_no string")
    ids = lambda c: sorted(r.doc_id for r in d.where(c).collect())
    assert ids(S.search_words("تعويض")) == ["a", "b"] and ids(S.search_words("في")) == [] and ids(S.search_words("تعويض الضرر")) == ["a"]
    assert ids(S.search_substring("الإدارية")) == ["b"] and ids(S.search_trigram("ضرر طلب")) == ["a"] and ids(S.search_substring("")) == []
    assert ids(S.number_or_text("42", S.search_substring("42"))) == ["b"]
    index = S.build_token_index(d)
    assert sorted(r.doc_id for r in S.search_index(index, "تعويض").collect()) == ["a", "b"]
    again = S.refresh_token_index(index, d.where("doc_id = 'a'").withColumn("search_text", F.lit("جديد")))
    assert sorted(r.doc_id for r in S.search_index(again, "تعويض").collect()) == ["b"]
    got = d.select(S.snippets("التعويض", "search_text", 3).alias("s")).collect()
    assert got[0].s == ["…لب «التعويض» عن…"]


def test_whole_documents_are_redacted_across_pages(spark):
    pages = spark.createDataFrame([("d", 1, "حضر محمد"), ("d", 2, "العلوي 0612345678"), ("d", 3, "انتهى"), ("e", 1, "محمد العلوي")], "doc_id string, page_no int, text string")
    values = spark.createDataFrame([("d", "محمد العلوي"), ("d", "غائب تماما")], "doc_id string, value string")
    got = {(r.doc_id, r.page_no): r for r in R.redact_document(pages, values).collect()}
    assert got["d", 1].text.strip() == "حضر XXXXXXX" and got["d", 2].text.strip() == "XXXXXXX" and got["d", 3].text == "انتهى" and got["e", 1].text == "محمد العلوي"
    assert got["d", 1].unmatched == ["غائب تماما"]


def test_proposals(spark):
    p = spark.createDataFrame([("1", "مدنية", "الكراء"), ("2", "مدنية", "كراء"), ("3", "تجارية", "كراء"), ("4", "مدنية", "نفقة")], "doc_id string, chamber string, proposed string")
    r = {x.key: x for x in J.proposal_review(p).collect()}
    assert (r["كراء"].label, r["كراء"].rulings, r["كراء"].chambers, r["كراء"].also_spelled) == ("كراء", 3, {"مدنية": 2, "تجارية": 1}, ["الكراء"])
    before = spark.createDataFrame([("كراء", True, "عقد الكراء")], "key string, approve boolean, label string")
    again = J.proposal_review(p, before)
    filed, left = J.apply_approvals(p, again)
    assert {x.label for x in filed.collect()} == {"عقد الكراء"} and [x.doc_id for x in left.collect()] == ["4"]


def test_files_and_streams(spark, tmp_path):
    for name in ("a/x.pdf", "a/x.docx", "a/y.pdf", "a/~$y.docx", "a/z.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(name.encode())
    found = files.discover_inputs(spark, str(tmp_path / "in")).select("doc_id", files.fingerprint("content").alias("h"))
    assert sorted(r.doc_id for r in found.collect()) == ["a/x_docx", "a/x_pdf", "a/y"]
    (tmp_path / "truth.json").write_text('{"d1": {"format": "pdf", "pii": ["x"], "fields": {"f": "1"}}}')
    assert files.load_truth(spark, str(tmp_path / "truth.json")).first().doc_id == "d1"
    (tmp_path / "records.json").write_text('[{"doc_id": "b", "status": "done", "links": [{"to": "x", "role": "reviews", "confidence": "high"}]}, {"doc_id": "a"}]')
    records = files.load_records(spark, str(tmp_path / "records.json"))
    assert C.flatten_records(records).where("links <> ''").first().links == "x(reviews,high)"
    files.write_records(records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    files.write_snapshot(records.select("doc_id"), str(tmp_path / "t"), 1)
    files.write_snapshot(records.select("doc_id").limit(1), str(tmp_path / "t"), 2)
    assert files.latest_snapshot(spark, str(tmp_path / "t")).count() == 1

    schema, table = "doc_id long, text string", str(tmp_path / "stored")
    empty = spark.createDataFrame([], "doc_id long, text string, content_hash string, clean boolean")
    stored = lambda: spark.read.parquet(table) if os.path.isdir(table) else empty
    run = lambda: incremental_ingest(spark, str(tmp_path / "feed"), schema, stored, lambda df, n: df.write.mode("append").parquet(table), str(tmp_path / "cp"))
    for rows in ([(1, "a"), (2, "a"), (3, "b@mail.com")], [(4, "a"), (5, "c")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "feed"))
        run()
    run()
    assert sorted((r.doc_id, r.clean) for r in stored().collect()) == [(1, True), (3, False), (5, True)]


def test_ranked_candidates_do_not_shuffle_pairs(spark):
    """Pairs are filtered where they meet: the join on keys is the last one, and the rows are those of rank_filter."""
    from docloom.operators import linkage as L

    docs = spark.createDataFrame([(i, lv, "c", "", "7", "1/2/2015", f"{i % 2}/1/2015") for i, lv in enumerate(["ابتدائي", "استئناف", "نقض", ""] * 3)], "doc_id long, level string, court string, city string, decision_no string, date string, file_no string")
    refs = docs.drop("level").unionByName(docs.drop("level").where("doc_id = 1").withColumn("doc_id", F.lit(99).cast("long"))).withColumn("ref_ix", F.lit(0))
    key = ["doc_id", "ref_ix", "child"]
    got = L.ranked_candidates(docs, refs, 2026).select(*key)
    want = L.rank_filter(L.link_candidates(docs, refs, 2026), docs).select(*key)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "key" in next(x for x in plan.splitlines() if "Join" in x)


def _counted(spark, df):
    """The same rows, and how often a row of them was worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_what_components_and_summaries_read_is_worked_out_once(spark):
    ids = range(40)
    docs = spark.createDataFrame([(i, f"C:{i // 4}", "ok", ("ابتدائي", "استئناف", "نقض", "")[i % 4], "", f"{i}/1/2015", "") for i in ids], "doc_id long, case_id string, review string, level string, court string, file_no string, category string")
    refs = spark.createDataFrame([(3, 0, "محكمة النقض"), (4, 0, ""), (99, 0, "محكمة النقض")], "doc_id long, ref_ix int, court string")
    counted, seen = _counted(spark, docs)
    rows = {r.case_id: r for r in L.case_summary(counted, refs).collect()}
    assert len(rows) == 10 and seen.value == 40
    assert rows["C:0"].docs == "0؛ 1؛ 2؛ 3" and rows["C:0"].cassated == "نعم"
    edges, seen = _counted(spark, spark.createDataFrame([(i, i - 1) for i in ids if i % 4], "a long, b long"))
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(i, i - i % 4) for i in ids}
    assert seen.value == 30


def test_edges_of_a_component_read_by_several_tasks_still_meet(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (None, 3)], "a long, b long").repartition(7)
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}
