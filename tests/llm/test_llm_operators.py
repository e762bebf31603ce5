"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann, chat, decontaminate, language_id, mixing, ngram_join, suffix_dedup, superkmer_dedup, url_filter, warc
from docloom.llm._shared import scratch

WORDS = "the of and to in that was from river mountain é über señor maison qui dans der und nicht para".split()
PASSAGE = " ".join(f"word{i}" for i in range(40))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def corpus():
    base = [sentence(i, 60 + i) for i in range(12)]
    near = base[3].replace("river", "RIVER ", 1) + " tail"
    texts = [*base, None, "", "  \n ", "one two", "One  Two", base[0], base[0], near, sentence(99, 40) + " " + PASSAGE, PASSAGE + "\n" + sentence(98, 30), sentence(97, 4000), "x" * 300, "x" * 300, "1234 5678", base[5] + "\t" + base[6]]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, base[7], None, "s1", 1), (None, None, "en", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame(corpus(), DOCS).repartition(3)
    return extra.withColumns({"n_units": F.lit("mine"), "size": F.lit("mine"), "rate": F.lit(None).cast("string"), "score": F.lit(1)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def brute_windows(rows, n, split, join):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for id, units in order:
        for p in range(len(units) - n + 1):
            w = join(units[p : p + n])
            key = float("inf") if id is None else id
            first[w] = min(first.get(w, float("inf")), key)
    out = []
    for id, units in order:
        key, gone = float("inf") if id is None else id, [False] * len(units)
        for p in range(len(units) - n + 1):
            if first[join(units[p : p + n])] < key:
                gone[p : p + n] = [True] * n
        out.append((id, len(units), sum(gone), hashlib.sha256(split.join([u for u, g in zip(units, gone, strict=True) if not g])).hexdigest()))
    return Counter(out)


def test_op3_against_brute_force(docs, empty):
    got = suffix_dedup.remove_repeated_bytes(docs, with_text=False)
    rows = [(r[0], [bytes([b]) for b in (r[1] or "").encode()]) for r in corpus()]
    want = brute_windows(rows, 50, b"", b"".join)
    assert Counter((r.doc_id, r.n_units, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


def test_op3_keeps_text_columns_and_nulls(docs):
    got = suffix_dedup.remove_repeated_bytes(docs)
    assert set(docs.columns) <= set(got.columns) and dict(got.dtypes)["n_units"] == "bigint"
    by = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert by[12].text is None and by[13].text == "" and by[0].text == corpus()[0][1]
    assert "word39" not in by[21].text and by[17].text == ""


def test_op10_against_brute_force(docs, empty):
    got = superkmer_dedup.remove_repeated_words(docs, with_text=False)
    rows = [(r[0], re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())) for r in corpus()]
    want = brute_windows(rows, 13, b" ", b" ".join)
    assert Counter((r.doc_id, r.n_units, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    assert superkmer_dedup.remove_repeated_words(empty).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                k = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k) and comp[i] != comp[j]:
                    comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
                    changed = True
    name = {}
    for (id, _), c in zip(rows, comp, strict=True):
        if id is not None:
            name[c] = min(name.get(c, id), id)
    return Counter((id, len(s), name.get(c) if s else id) for (id, _), s, c in zip(rows, sets, comp, strict=True))


def test_op1_against_brute_force(spark, docs, empty):
    got = ngram_join.link_documents(docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components([(r[0], r[1]) for r in corpus()])
    assert ngram_join.link_documents(empty).count() == 0


def test_op1_chains_of_near_copies(spark):
    """Sets that drift step by step link only with their neighbours, and all are one component."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(40)] + [(100 + i, " ".join(np.random.default_rng(i).permutation(words)[:50])) for i in range(20)]
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    linked = lambda a, b: a and b and 100 * len(a & b) >= 80 * (len(a) + len(b) - len(a & b))
    return Counter((id, sum(bool(linked(s, x)) for j, x in enumerate(sets) if j != i)) for i, ((id, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_op1_counts_all_links_within_components(spark, docs, empty, monkeypatch):
    """Chains, copies and a group of near copies larger than a block."""
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(3)
    near = [" ".join(w if rng.random() > 0.01 else f"x{i}" for w in words[:150] for i in rng.integers(0, 99, 1)) for _ in range(40)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60 + i % 3])) for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate([*near, near[0], near[0], near[7], "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (7, 256):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = Counter((r.doc_id, r.n_links) for r in ngram_join.link_documents(df).collect())
        assert got == brute_links(rows) and max(n for _, n in got) > 3
    assert Counter((r.doc_id, r.n_links) for r in ngram_join.link_documents(docs).collect()) == brute_links([(r[0], r[1]) for r in corpus()])
    assert ngram_join.link_documents(empty).where("n_links > 0").count() == 0
    monkeypatch.setattr(ngram_join, "COLUMNS", 3)
    few = [np.unique(rng.integers(0, 12, 8)) for _ in range(6)]
    shared = np.array([[len(np.intersect1d(x, y)) for y in few] for x in few])
    flat, count = np.concatenate(few), np.array([len(x) for x in few])
    assert (ngram_join._overlaps(flat, count, 6, True) == shared).all() and (ngram_join._overlaps(flat, count, 2, False) == shared[:2, 2:]).all()


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_op2_against_brute_force(spark, docs, empty):
    items = [("b", PASSAGE), ("a", "One. Two"), ("c", None), ("d", "..."), ("e", " ".join(corpus()[2][1].split()[5:18]).upper())]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.judge(docs, bench).collect()}
    want = set()
    for id, text, *_ in corpus():
        w, gone, names = item_words(text), set(), set()
        for name, item in items:
            iw = item_words(item)
            n = min(10, len(iw))
            wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in wins:
                    gone |= set(range(p, p + n))
                    names.add(name)
        want.add((id, len(w), len(gone), tuple(sorted(names)), bool(gone)))
    assert got == want
    assert decontaminate.judge(empty, bench).count() == 0 and decontaminate.judge(docs, bench.limit(0)).where("contaminated").count() == 0
    kept = {r.doc_id: r.text for r in decontaminate.remove_hits(docs, bench).where("doc_id is not null").collect()}
    assert kept[20].strip() == sentence(99, 40) and 15 not in kept and kept[12] is None and kept[1] == corpus()[1][1]


def test_op2_blocks_of_windows_give_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame([("b", PASSAGE), ("e", corpus()[2][1])], "item_id string, text string")
    whole = sorted(map(str, decontaminate.judge(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 7)
    assert sorted(map(str, decontaminate.judge(docs, bench).collect())) == whole


def test_op4_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[100:160] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(3001, None), (3020, [0.0] * 16), (3040, [float("nan")] + [1.0] * 15), (3060, [None] + [1.0] * 15), (3080, [float("inf")] + [1.0] * 15), (3100, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, embedding array<float>").withColumn("rank", F.lit("mine"))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 20))
    for q, found in by.items():
        found.sort()
        order = sorted((i for i in range(3000) if i != q), key=lambda i: (-exact[q, i], i))[:20]
        hits += len(set(order) & {v for _, v, _ in found})
        total += 20
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - exact[q, v]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    assert hits / total >= 0.9
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_op4_descent_rounds_improve_a_poor_start(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "CELL", 64)
    truth = {q: set(np.argsort(-(x @ x[q]), kind="stable")[:21]) - {q} for q in range(0, 1500, 20)}
    recall = {}
    for rounds in (0, 3):
        got = ann.nearest(df, F.col("vec_id") % 20 == 0, degree=30, tables=2, rounds=rounds).collect()
        recall[rounds] = sum(r.vec_id in truth[r.query_id] for r in got) / sum(len(t) for t in truth.values())
    assert recall[3] >= 0.9 and recall[3] > recall[0]


def test_op4_rounds_go_on_until_settled(spark, monkeypatch):
    """A poor start of a small table is improved too: rounds follow what they change, not the size."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "CELL", 64)
    written = []
    monkeypatch.setattr(ann._shared, "written", lambda d, name, f=ann._shared.written: written.append(name) or f(d, name))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, degree=30, tables=2).collect()
    truth = {q: set(np.argsort(-(x @ x[q]), kind="stable")[:21]) - {q} for q in range(0, 1500, 20)}
    assert sum(r.vec_id in truth[r.query_id] for r in got) / sum(len(t) for t in truth.values()) >= 0.9
    assert written.count("graph") > 1 + 2


def test_op4_keeps_different_vectors_of_the_same_ids(spark):
    """Two vectors whose smallest id is the same are two nodes, whichever comes first."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.1, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id): round(r.score, 6) for r in ann.nearest(df, F.col("vec_id").isin(1, 2), k=2).collect()}
    assert got == {(1, 0): 1.0, (1, 3): 0.9, (2, 0): 1.0, (2, 4): 0.9}


def test_op5_targets_and_rounding(spark, docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(corpus())
    sizes, names = Counter(), sorted({r[3] for r in corpus() if r[3]}) + [None]
    for r in corpus():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    targets, left, over = {}, sum(sizes.values()), set()
    while True:
        share = (left - sum(3 * sizes[s] for s in over)) / max(1, sum(w for s, w in weight.items() if s not in over))
        new = {s for s in weight if s not in over and share * weight[s] > 3 * sizes[s]}
        if not new:
            break
        over |= new
    targets = {s: 3 * sizes[s] if s in over else share * weight[s] for s in weight}
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in targets.values()})
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    assert mixing.mix_sources(docs).exceptAll(mixing.mix_sources(docs)).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    whole = mixing.mix_sources(docs, with_text=True)
    assert whole.count() == len(corpus()) and dict(whole.dtypes)["size"] == "bigint" and "text" in whole.columns


def test_op5_sources_come_near_their_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(n), f"s{i % 5}") for i, n in enumerate(rng.lognormal(4, 1, 2000))]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum(F.col("rate") * F.col("size")).alias("want")).collect():
        assert abs(r.want - r.target) <= 1e-3 * r.target and abs(r.taken - r.target) <= 0.01 * r.target


def language_rows():
    words = {"en": "the of and to in that was from river with".split(), "fr": "le la et les des qui dans pour être maison".split(), "de": "der die und nicht auch über werden schön ist".split()}
    rng = np.random.default_rng(4)
    return [(i, " ".join(rng.choice(words[lang], 30)), lang) for i, lang in enumerate(list(words) * 60)]


def test_op6_held_out_accuracy_and_edges(spark):
    rows = language_rows()
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "fr"), (902, "12 34 !!", "de"), (None, rows[0][1], "zz"), (903, rows[1][1], None), (904, rows[2][1] * 400, "de")], "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    model = language_id.fit(df)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    held = {r.doc_id for r in df.where(language_id.held_out(F.col("doc_id"))).collect()}
    assert len(held) > 20 and all(got[i].lang_pred == lang for i, _, lang in rows if i in held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred == "fr" and got[904].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(df.limit(0), model).count() == 0
    none = language_id.fit(df.where("lang is null"))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}


def test_op6_code_lengths_are_those_of_the_escape_rule(spark):
    """Against a direct evaluation of the context trees."""
    import pyarrow as pa

    rows = [(1, "abab abac", "x"), (2, "aabb", "y"), (3, "abab abac", "x")]
    df = spark.createDataFrame([(i, t, lang) for i, t, lang in rows for _ in range(1)], "doc_id long, text string, lang string")
    train = [r for r in rows if not df.where(f"doc_id = {r[0]}").select(language_id.held_out(F.col("doc_id"))).first()[0]]
    model = language_id.fit(df)
    for lang_ix, lang in enumerate(model.languages):
        trees = [Counter() for _ in range(4)]
        for _, t, name in train:
            if name == lang:
                b = b"   " + t.encode()
                for i in range(3, len(b)):
                    for k in range(4):
                        trees[k][(b[i - k : i], b[i])] += 1

        def p(ctx, sym, k, trees=trees):
            if k < 0:
                return 1 / 256
            after = {s: n for (c, s), n in trees[k].items() if c == (ctx[len(ctx) - k :] if k else b"")}
            n, d = sum(after.values()), len(after)
            if not n:
                return p(ctx, sym, k - 1)
            return after[sym] / (n + d) if sym in after else d / (n + d) * p(ctx, sym, k - 1)

        text = b"   abba c"
        bits = sum(-np.log2(p(text[i - 3 : i], text[i], 3)) for i in range(3, len(text)))
        assert language_id.code_lengths(model, pa.array(["abba c"]))[0][lang_ix] == pytest.approx(bits, rel=1e-4)


def test_op7_links_orders_and_validates(spark):
    schema = "conv_id long, turn long, role string, content string, kind string, call_id string, name string, arguments string, rank string"
    rows = [
        (1, 1, "assistant", "ask", "call", "c1", "get", '{"b":"x","a":3}', "mine"),
        (1, 2, "tool", "late", "result", "c2", None, None, None),
        (1, 3, "assistant", "ask", "call", "c2", "get", '{"a":"no"}', None),
        (1, 4, "tool", "answer", "result", "c1", None, None, None),
        (1, 5, "user", "hello", "message", None, None, None, None),
        (2, 1, "tool", None, "result", "lost", None, None, None),
        (2, 2, "assistant", "x", "call", "open", "unknown", "{}", None),
        (None, None, None, None, None, None, None, None, None),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.link_calls(spark.createDataFrame(rows, schema), {"get": [("a", "integer", True), ("b", "string", False)]}).collect()}
    order = sorted((k for k in got if k[0] == 1), key=lambda k: got[k].rank)
    assert order == [(1, 1), (1, 4), (1, 3), (1, 2), (1, 5)]
    assert got[1, 1].valid and not got[1, 3].valid and not got[2, 2].valid and got[1, 4].valid
    assert got[2, 1].linked is False and got[1, 5].linked is None
    assert got[1, 1].message == '{"arguments":"{\\"a\\":3,\\"b\\":\\"x\\"}","call_id":"c1","name":"get","role":"assistant"}'
    assert json.loads(got[1, 4].message) == {"call_id": "c1", "content": "answer", "role": "tool"}
    assert chat.link_calls(spark.createDataFrame([], schema), {"get": []}).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, 1, "assistant", None), (1, None, "user", "q"), (1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    assert chat.link_calls(chat.turns_as_calls(turns), chat.ASK).count() == 5


def test_op7_json_types_and_identifiers_of_several_conversations(spark):
    schema = "conv_id long, turn long, role string, content string, kind string, call_id string, name string, arguments string"
    fields = {k: [("v", k, True)] for k in ("string", "integer", "number", "boolean", "array", "object")}
    values = {"5": {"integer", "number"}, '"3"': {"string"}, "1.5": {"number"}, "true": {"boolean"}, "[1]": {"array"}, '{"a":1}': {"object"}, "null": set()}
    cases = [(k, v, k in kinds) for v, kinds in values.items() for k in fields]
    rows = [(1, i, "assistant", None, "call", f"t{i}", k, '{"v":%s}' % v) for i, (k, v, _) in enumerate(cases)]
    rows += [(2, 500, "assistant", None, "call", "call_1", "any", '{"b":{"y":1,"x":2},"a":3}'), (3, 501, "tool", "r", "result", "call_1", None, None), (4, 502, "assistant", None, "call", "call_1", "any", '{"a": 3, "b": {"x": 2, "y": 1}}'), (4, 503, "tool", "r", "result", "call_1", None, None)]
    got = {r.turn: r for r in chat.link_calls(spark.createDataFrame(rows, schema), fields).collect()}
    assert [got[i].valid for i in range(len(cases))] == [ok for _, _, ok in cases]
    assert [got[t].linked for t in (500, 501, 502, 503)] == [False, False, True, True] and got[503]["rank"] == 1005
    assert got[500].canonical_arguments == got[502].canonical_arguments == '{"a":3,"b":{"x":2,"y":1}}'


def test_op8_longest_rule_wins_by_trie_and_by_join(spark, monkeypatch):
    rules = spark.createDataFrame([("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.Example.com", "/en/"), ("block", "net", "/e"), ("allow", "net", "/e"), (None, "org", "/"), ("block", "a.b", "")], "verdict string, host string, path string")
    urls = {
        "http://x.com/": ("x.com", "/", "com/", "allow"),
        "http://xcom/": ("xcom", "/", None, "allow"),
        "https://EXAMPLE.com/en/1?q#f": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://example.com/en": ("example.com", "/en", "com/", "allow"),
        "ftp://q.net/es/x": ("q.net", "/es/x", "net/e", "block"),
        "http://q.com?x://y.net/es/": ("q.com", "", None, "allow"),
        "http://z.a.b": ("z.a.b", "", "a.b", "block"),
        "no url": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    want = sorted(map(str, [*urls.values()] * 2))
    for most in (10, 0):
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", most)
        got = url_filter.filter_urls(pages, rules)
        assert sorted(str((r.host, r.path, r.rule, r.verdict)) for r in got.collect()) == want
        assert url_filter.filter_urls(pages.limit(0), rules).count() == 0 and url_filter.filter_urls(pages, rules.limit(0)).where("rule is not null").count() == 0


def test_op9_round_trip(spark):
    big = "WARC/1.1\r\nWARC-Type: x\r\n\r\n" + "é" * 30000 + "WARC/1.1"
    pages = [(5, "http://a/\r\nb", big), (2, None, big), (None, "http://n", big), (3, "u", None), (4, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "y" * 100), (8, "u", "y" * 100), (9, "u", "z\r\n\r\n0\r\n\r\n" * 20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("mine")).repartition(3)
    stored = scratch(spark, "pages")
    df.write.parquet(stored)
    df = spark.read.parquet(stored)
    path = scratch(spark, "warc")
    warc.write_warc(df, path, segment_bytes=4096)
    records = warc.read_records(spark, path)
    assert records.where("segment > 1").count() > 5
    got = warc.pages_of(warc.reassemble(records)).collect()
    assert len(got) == len(pages) and {r.status for r in got} == {"ok"}
    body = {i: (h or "").encode() for i, _, h in pages}
    for r in got:
        assert r.payload_bytes == len(body[r.page_id]) and r.payload_digest == hashlib.sha256(body[r.page_id]).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == body[r.page_id]
    assert sorted(str((r.page_id, r.refers_to)) for r in got if r.record_type == "revisit") == ["(5, 2)", "(8, 8)", "(None, 2)"]
    broken = records.where("segment is null or segment <> 2")
    assert {r.status for r in warc.reassemble(broken).collect()} == {"ok", "missing segment"}
    nothing = scratch(spark, "warc")
    warc.write_warc(df.limit(0), nothing)
    assert warc.reassemble(warc.read_records(spark, nothing)).count() == 0


def test_chunks_never_hold_the_record_marker():
    for payload in (b"", b"WARC/1.1", b"aWARC/1.1\r\nWARC/1.1\r\n", b"WARWARC/1.1" * 9):
        block = warc.chunked(payload, 7)
        assert warc.MARK not in block and warc.unchunked(b"HTTP/1.1 200 OK\r\n\r\n" + block) == payload
    assert warc.unchunked(b"HTTP/1.1 200 OK\r\n\r\nzz\r\n") is None
