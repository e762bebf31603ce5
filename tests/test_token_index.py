"""The index in levels against one built anew, and what its look-ups read."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from docloom.operators import search as S
from docloom.operators import token_index as I
from docloom.operators.components import shared_dir

WORDS = ["تعويض", "التعويض", "كراء", "الكراء", "اداء", "الاداء", "طلاق", "عقد", "شفعه", "نفقه"]


def test_many_refreshes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    """New, changed and removed documents; a refresh of nothing; searches from the rarest word on, handed on or joined."""
    rng = random.Random(3)
    index, live = I.TokenIndex(spark, str(tmp_path / "index")), {}
    shape = "doc_id long, search_text string"
    for step, size in enumerate([60, 6, 1, 0, 3, 30, 2]):
        put = {rng.randrange(80): " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 8))) for _ in range(size)}
        gone = [i for i in rng.sample(range(80), 4) if i not in put] if step else []
        index.refresh(spark.createDataFrame(list(put.items()), shape), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        live = {i: t for i, t in (live | put).items() if i not in gone}
    assert 1 < len(index.runs()) <= 4
    docs = spark.createDataFrame(list(live.items()), shape)
    pairs = lambda df: sorted((r.token, r.doc_id) for r in df.collect())
    assert pairs(index.postings()) == pairs(S.build_token_index(docs))
    for most in (1000, 2):
        monkeypatch.setattr(I, "HANDED_ON", most)
        for query in ("تعويض", "كراء في عقد", "طلاق نفقة اداء"):
            assert sorted(r.doc_id for r in index.search(query).collect()) == sorted(r.doc_id for r in docs.where(S.search_words(query)).collect()), query
    assert index.search("في").count() == 0
    assert index.store.vacuum(keep=1) > 0 and pairs(index.postings()) == pairs(S.build_token_index(docs))


def test_a_look_up_reads_the_row_groups_of_its_words_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "ROW_GROUP", 4096)
    index = I.TokenIndex(spark, str(tmp_path / "index"))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" common")).alias("search_text"))
    index.refresh(docs)

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        return leaf.metrics().get("numOutputRows").get().value()

    total = scanned(index.postings())
    assert total == 40_000
    assert scanned(index.postings(F.col("token").startswith("w0012"))) < total / 10
    # of a common word, only the row groups of the documents that are asked for
    assert scanned(index.postings((F.col("token") == "common") & F.col("doc_id").isin([7, 9]))) < total / 10
    assert [r.doc_id for r in index.search("w001234 common").collect()] == [1234]


def test_a_refresh_is_kept_in_compressed_tables(spark, tmp_path):
    """Checkpoints keep rows uncompressed, and were more than all else that a refresh wrote."""
    held = lambda: {p for p in Path(shared_dir(spark).removeprefix("file:")).glob("rdd-*")}
    before = held()
    index = I.TokenIndex(spark, str(tmp_path / "index"))
    index.refresh(spark.createDataFrame([("D1", "تعويض كراء"), ("D2", "تعويض")], "doc_id string, search_text string"))
    assert sorted(r[0] for r in index.search("تعويض").collect()) == ["D1", "D2"] and held() == before
