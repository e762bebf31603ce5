"""Hot keys, clashing names, many languages, dependencies of calls, and the registered queries against plain versions."""

import hashlib
import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import _windows, ann, chat, decontaminate, language_id, mixing, ngram_join, queries, suffix_dedup, superkmer_dedup, url_filter

WORDS = "the of and to in that was from river mountain é über señor maison qui dans der und nicht para".split()
#: Names that operators use inside, for columns and for what they join.
INNER = ["row", "id", "id2", "key", "dest", "bucket", "blob", "h", "s", "n", "size", "pos", "len", "words", "gaps", "at", "spans", "text_hash", "hash2", "judged", "bits", "odds", "match", "url_host", "url_path", "called", "answered", "end_call", "end_conv", "call_rank", "in_order", "good", "valid", "of", "lam", "mean", "none", "c0", "items", "a b", "dot.ted", "tick`ed", "_id", "_text", "_dest", "_key", "_at", "_words", "_match", "_judged", "_end", "_called", "_valid", "_host", "_path"]


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def named(df, *but):
    """``df`` with a column of every inner name that it has not."""
    have = {c.lower() for c in df.columns} | set(but)
    return df.select("*", *[F.concat(F.lit(f"mine {i}-"), F.monotonically_increasing_id().cast("string")).alias(c) for i, c in enumerate(INNER) if c not in have])


def kept_as_they_were(before, after, key, replaced=()):
    """Every inner column of the rows that are left holds what it held."""
    cols = [c for c in before.columns if c in INNER and c not in replaced]
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    was = {r[0]: tuple(r)[1:] for r in before.select(q(key), *[q(c) for c in cols]).collect()}
    now = {r[0]: tuple(r)[1:] for r in after.select(q(key), *[q(c) for c in cols]).collect()}
    assert now and len(cols) > 30 and all(was[k] == v for k, v in now.items())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    passage = " ".join(f"word{i}" for i in range(40))
    texts = [sentence(i, 80) for i in range(8)] + [sentence(90, 30) + " " + passage, passage + " " + sentence(91, 30), None, "", sentence(3, 80)]
    path = str(tmp_path_factory.mktemp("stored") / "t")
    df = spark.createDataFrame([(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    named(df, "size").coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def test_clashing_names_op2_op3_op5_op6_op10(spark, stored):
    bench = spark.createDataFrame([("b", " ".join(f"word{i}" for i in range(40)))], "item_id string, text string")
    cleaned = decontaminate.remove_hits(stored, bench)
    assert cleaned.columns == stored.columns and cleaned.count() == stored.count()
    kept_as_they_were(stored, cleaned, "doc_id")
    assert decontaminate.judge(stored, bench).where("contaminated").count() == 2
    for dedupe in (suffix_dedup.remove_repeated_bytes, superkmer_dedup.remove_repeated_words):
        kept_as_they_were(stored, dedupe(stored), "doc_id")
    kept_as_they_were(stored, mixing.mix_sources(stored, with_text=True), "doc_id")
    kept_as_they_were(stored, language_id.identify(stored, language_id.fit(stored)), "doc_id")
    assert {r.doc_id for r in ngram_join.link_documents(stored).where("component_id = 3").collect()} == {3, 12}


def test_clashing_names_op7_op8(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    calls = named(chat.turns_as_calls(turns).withColumn("nr", F.monotonically_increasing_id()), "valid").coalesce(1)
    kept_as_they_were(calls, chat.link_calls(calls, chat.ASK), "nr")
    pages = named(spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")).coalesce(1)
    rules = spark.createDataFrame([("block", "a.com", "/")], "verdict string, host string, path string")
    kept_as_they_were(pages, url_filter.filter_urls(pages, rules), "page_id")


def brute_removed(rows, n, split):
    first, out = {}, {}
    for id, units in rows:
        for p in range(len(units) - n + 1):
            w = tuple(units[p : p + n])
            first[w] = min(first.get(w, id), id)
    for id, units in rows:
        gone = [False] * len(units)
        for p in range(len(units) - n + 1):
            if first[tuple(units[p : p + n])] < id:
                gone[p : p + n] = [True] * n
        out[id] = (sum(gone), hashlib.sha256(split.join(u for u, g in zip(units, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [0, 3, 20_000])
def test_hot_minimisers_are_split(spark, monkeypatch, hot):
    """A passage and a phrase in most documents, in contexts that differ, with other spaces between the words."""
    monkeypatch.setattr(_windows, "HOT", hot)
    phrase, passage = "all rights reserved by", " ".join(f"part{i}" for i in range(30))
    rng = np.random.default_rng(0)
    rows = [(i, f"{sentence(i, 20)} {phrase} {sentence(i % 7, 20)} {passage if i % 3 else passage.replace(' ', '  ')} {sentence(i % 5, int(rng.integers(3, 30)))}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in superkmer_dedup.remove_repeated_words(df, with_text=False).collect()}
    assert got == brute_removed([(i, re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for i, t in rows], 13, b" ")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeated_bytes(df, with_text=False).collect()}
    assert got == brute_removed([(i, [bytes([b]) for b in t.encode()]) for i, t in rows], 50, b"")


def test_strings_with_equal_hashes_are_compared():
    body = np.frombuffer(b"aaaabbbbaaaacccc", np.uint8)
    length, string = np.array([4, 4, 4, 4]), np.zeros(4, np.uint64)
    assert _windows._settled(np.array([1, 2, 3, 4]), string, length, body).tolist() == [False, False, True, False]
    words = np.frombuffer(b"a bc a bd a bc", np.uint8)
    start, size, word = np.array([0, 2, 5, 7, 10, 12]), np.array([1, 2, 1, 2, 1, 2]), np.array([0, 2, 4])
    same = superkmer_dedup._same_words(words, start, size, word[[1, 2]], word[[0, 0]], 2)
    assert same.tolist() == [False, True]
    asked = superkmer_dedup._by_words(words, start, size, word, np.zeros(3, np.uint64), np.array([1, 2, 3]), np.zeros(1, np.uint64), np.array([1, 2]), 2)
    assert asked.tolist() == [2]


def test_levels_of_suffixes_merge_and_grow():
    rng = np.random.default_rng(1)
    family, seen = suffix_dedup.SuffixArrays(), {}
    for batch in range(40):
        raw = np.array([f"{x:03d}".encode() for x in rng.integers(0, 400, 30)], "S3")
        keys, docs = family.array(raw, np.full(30, batch))
        before = family.least(keys, docs)
        assert before.tolist() == [min(batch, seen.get(k, batch)) for k in keys.tolist()]
        family.add(keys, docs)
        for k in keys.tolist():
            seen.setdefault(k, batch)
    assert all((np.diff(np.argsort(level[0], kind="stable")) == 1).all() for level in family.levels)
    assert len(family.levels) < 8 and {k: d for level in family.levels[::-1] for k, d in zip(level[0].tolist(), level[1].tolist(), strict=True)} == seen


def many_languages(n, docs=6):
    rng = np.random.default_rng(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicons = [["".join(letters[x] for x in rng.integers(0, 26, 5)) for _ in range(12)] for _ in range(n)]
    return [(i * docs + j, " ".join(rng.choice(lexicons[i], 40)), f"l{i:03d}") for i in range(n) for j in range(docs)]


def test_op6_predicts_each_of_many_languages(spark, monkeypatch):
    rows = many_languages(90)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(df)
    assert len(model.languages) == 90 and len(model.blocks) == 1
    got = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language_id.identify(df, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    monkeypatch.setattr(language_id, "MAX_ENTRIES", 5000)
    parts = language_id.fit(df)
    assert len(parts.blocks) > 5 and parts.languages == model.languages
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language_id.identify(df, parts).collect()} == got


def test_op6_learns_from_whole_texts_within_its_bound_and_scores_mixtures_low(spark):
    rows = many_languages(2, 40)
    mixed = [(1000, rows[0][1] + " " + rows[40][1], None), (1001, None, "l000"), (1002, None, "l002")] + [(2000 + i, None, "l001") for i in range(400)]
    df = spark.createDataFrame([*rows, *mixed], "doc_id long, text string, lang string").coalesce(3)
    small = language_id.fit(df, sample_bytes=1)
    assert small.languages == ["l000", "l001"] and all(len(s.bits) for s in small.blocks[0].seen)
    got = {r.doc_id: r for r in language_id.identify(df, language_id.fit(df)).collect()}
    assert got[1000].score < 0.9 < got[0].score and got[1001].lang_pred == "und"


def test_op7_arguments_are_parsed_with_their_types(spark):
    """Wrong types, nested values, a key twice, other spacing and order."""
    cases = {'{"a":"3"}': False, '{"a":3,"b":5}': False, '{"a":3,"b":{"x":1}}': False, '{"a":3,"a":4}': False, '{ "b" : "x" , "a" : 3 }': True}
    schema = "conv_id long, turn long, role string, content string, kind string, call_id string, name string, arguments string"
    rows = [(1, i, "assistant", None, "call", f"c{i}", "get", a) for i, a in enumerate(cases)]
    got = {r.turn: r for r in chat.link_calls(spark.createDataFrame(rows, schema), {"get": [("a", "integer", True), ("b", "string", False)]}).collect()}
    assert [got[i].valid for i in range(len(cases))] == list(cases.values())
    assert got[4].canonical_arguments == '{"a":3,"b":"x"}' and json.loads(got[4].message)["arguments"] == '{"a":3,"b":"x"}'
    assert got[3].canonical_arguments is None and json.loads(got[3].message)["arguments"] == '{"a":3,"a":4}'
    for r in got.values():
        assert r.message == json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"))


def test_op7_calls_come_behind_the_results_they_use(spark):
    schema = "conv_id long, turn long, role string, content string, kind string, call_id string, name string, arguments string"
    call = lambda c, t, i, *uses: (c, t, "assistant", None, "call", i, "f", json.dumps({"from": list(uses), "n": 1}))
    result = lambda c, t, i: (c, t, "tool", "r", "result", i, None, None)
    rows = [call(1, 0, "z", "y"), call(1, 1, "y", "x"), call(1, 2, "x"), result(1, 3, "z"), result(1, 4, "y"), result(1, 5, "x"), (1, 6, "user", "hi", "message", None, None, None)]
    rows += [call(2, 0, "p", "q"), call(2, 1, "q", "p"), call(2, 2, "r", "q"), result(2, 3, "p"), call(2, 4, "s"), call(3, 0, "x", "nowhere"), call(3, 1, "t", "t")]
    got = {(r.conv_id, r.turn): r for r in chat.link_calls(spark.createDataFrame(rows, schema).repartition(3), {}).collect()}
    order = [t for _, t in sorted((k for k in got if k[0] == 1), key=lambda k: (got[k]["rank"], k))]
    assert order.index(2) < order.index(5) < order.index(1) < order.index(4) < order.index(0) < order.index(3)
    assert [got[2, t].ordered for t in range(5)] == [False, False, False, False, True] and got[3, 0].ordered and got[3, 1].ordered
    assert got[1, 6].ordered is None and all(got[k].ordered for k in got if k[0] == 1 and k[1] < 6)


def test_op2_beyond_the_broadcast_bound_and_shared_windows(spark, stored, monkeypatch):
    words = [f"word{i}" for i in range(40)]
    items = [(f"i{j}", " ".join(words[j % 5 : j % 5 + 12])) for j in range(30)] + [(None, " ".join(words[3:9]) + " zz " + " ".join(words[20:30])), ("short", "mountain river mountain")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    twice = stored.unionByName(stored.where("doc_id = 8"))
    whole = sorted(map(str, decontaminate.judge(twice, bench).collect()))
    assert len(whole) == twice.count() and any("n_items=31" in x for x in whole)
    kept = sorted(map(str, decontaminate.remove_hits(twice, bench).select("doc_id", "text").collect()))
    for name in ("MAX_WINDOWS", "MAX_CHARS"):
        with monkeypatch.context() as m:
            m.setattr(decontaminate, name, 3)
            assert sorted(map(str, decontaminate.judge(twice, bench).collect())) == whole
            assert sorted(map(str, decontaminate.remove_hits(twice, bench).select("doc_id", "text").collect())) == kept


def solved_targets(sizes, weights):
    """Sharing and stopping as the contract says it."""
    left, stopped, target = sum(sizes), set(), {}
    while len(stopped) < len(sizes):
        unit = (left - sum(3 * sizes[i] for i in stopped)) / sum(w for i, w in enumerate(weights) if i not in stopped)
        new = {i for i, w in enumerate(weights) if i not in stopped and unit * w > 3 * sizes[i]}
        if not new:
            break
        stopped |= new
    return [3 * sizes[i] if i in stopped else unit * weights[i] for i in range(len(sizes))], stopped


def test_op5_against_an_independent_solver(spark):
    """Targets, rates by bisection, the whole rounding; 300 sources, so that many stop and ranks cross ranges."""
    rng = np.random.default_rng(5)
    names = [f"s{i:03d}" for i in range(299)] + [None]
    rows = [(i, "w " * int(n), names[int(s)], "x") for i, (n, s) in enumerate(zip(rng.lognormal(3, 1, 4000), rng.integers(0, 300, 4000) ** 2 // 300, strict=True))]
    rows += [(9000, None, "s000", "x"), rows[5], rows[5], *((9100 + i, "w " * (i + 1), None, "x") for i in range(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string").repartition(5)
    got = mixing.mix_sources(df, with_text=True).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(r[:3] for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    order = sorted((s for s in by if s is not None)) + [None]
    sizes = [sum(r.size for r in by[s]) for s in order]
    want, stopped = solved_targets(sizes, [i % 3 + 1 for i in range(len(order))])
    assert len(stopped) > 5
    for s, t, total in zip(order, want, sizes, strict=True):
        docs = by[s]
        assert all(r.source_size == total and abs(r.target - t) < 1e-6 * t for r in docs)
        size = np.array([r.size for r in docs], float)
        z = size / (total / len(docs))
        lo, hi = -1e4, 1e4
        for _ in range(200):
            lam = (lo + hi) / 2
            rate = np.exp(np.minimum(lam * z, np.log(3)))
            lo, hi = (lam, hi) if (rate * size).sum() < t else (lo, lam)
        assert np.allclose([r.rate for r in docs if r.size], rate[size > 0], rtol=1e-3)
        assert all(abs(r.copies - r.rate) < 1 for r in docs)
        assert abs(sum(r.taken for r in docs) - sum(r.rate * r.size for r in docs)) <= max(r.size for r in docs)
    again = mixing.mix_sources(df.repartition(2, "source"), with_text=True)
    assert Counter((r.doc_id, r.taken) for r in again.collect()) == Counter((r.doc_id, r.taken) for r in got)


def test_op8_many_tails_of_one_place(spark):
    rules = spark.createDataFrame([("block", "h.com", f"/d/{'x' * (i % 7)}{i:05d}") for i in range(4000)] + [("allow", "h.com", "/d/")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(0, "http://h.com/d/00007.html"), (1, "http://h.com/d/x00008"), (2, "http://h.com/d/x8"), (3, "http://www.h.com/d/xx00009/y")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {0: ("h.com/d/00007", "block"), 1: ("h.com/d/x00008", "block"), 2: ("h.com/d/", "allow"), 3: ("h.com/d/xx00009", "block")}


def test_op1_long_lists_in_parts_and_form_letters(spark, monkeypatch):
    """Letters of 8 of 12 blocks in random order, near copies and drifting sets, with lists cut into parts of a few classes."""
    rng = np.random.default_rng(11)
    blocks = [" ".join(f"b{b}w{i}" for i in range(14)) for b in range(12)]
    rows = [(i, " ".join(blocks[b] for b in rng.permutation(12)[:8])) for i in range(80)]
    rows += [(100 + i, " ".join(w if rng.random() > 0.02 else f"x{i}" for w in rows[i % 5][1].split())) for i in range(40)]
    words = [f"w{i}" for i in range(400)]
    rows += [(200 + i, " ".join(words[2 * i : 2 * i + 60])) for i in range(40)]
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    comp = {i: i for i in sets}
    for _ in range(60):
        comp = {i: min(comp[j] for j in sets if linked(sets[i], sets[j])) for i in sets}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for part in (5, 4096):
        monkeypatch.setattr(ngram_join, "PART", part)
        got = {r.doc_id: r.component_id for r in ngram_join.link_documents(df, links_counted=False).collect()}
        assert got == comp
    assert 10 < len(set(comp.values())) < 120


def test_op1_never_compares_a_pair_twice(spark, monkeypatch):
    seen = []
    kept = ngram_join._measured
    monkeypatch.setattr(ngram_join, "_measured", lambda pairs, sets: seen.extend((min(r.a, r.b), max(r.a, r.b)) for r in pairs.select("a", "b").collect()) or kept(pairs, sets))
    rng = np.random.default_rng(2)
    blocks = [" ".join(f"b{b}w{i}" for i in range(10)) for b in range(8)]
    rows = [(i, " ".join(blocks[b] for b in rng.permutation(8)[:5])) for i in range(60)]
    assert ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), links_counted=False).count() == 60
    later = Counter(seen)
    centres = 60
    assert len(seen) > centres and sum(n - 1 for n in later.values()) <= centres  # two classes may be each other's centre


def test_op7_long_chains_and_rings_of_calls(spark):
    """Two thousand calls of which each needs the one before, in either order of turns; a ring and what is behind it."""
    rows = [("up", i, f"k{i}", f'{{"x":"k{i - 1}"}}' if i else "{}") for i in range(2000)]
    rows += [("down", 2000 - i, f"k{i}", f'{{"x":"k{i - 1}","y":"k{i // 2}"}}' if i > 1900 else f'{{"x":"k{i - 1}"}}' if i else "{}") for i in range(2000)]
    rows += [("ring", i, c, a) for i, (c, a) in enumerate([("a", '{"x":"b"}'), ("b", '{"x":"c","y":"d"}'), ("c", '{"x":"a"}'), ("d", "{}"), ("e", '{"x":["a","d"]}'), ("f", '{"x":["d"]}')])]
    schema = "conv_id string, turn long, role string, content string, kind string, call_id string, name string, arguments string"
    made = spark.createDataFrame([(c, t, "user", None, "call", i, "n", a) for c, t, i, a in rows], schema)
    got = {(r.conv_id, r.call_id): (r["rank"], r.ordered) for r in chat.link_calls(made, {}).collect()}
    turns = {(c, i): t for c, t, i, _ in rows}
    for conv in ("up", "down"):
        last = -2
        for i in range(2000):
            last = max(2 * turns[conv, f"k{i}"], last + 2)
            assert got[conv, f"k{i}"] == (last, True)
    assert {k[1]: v for k, v in got.items() if k[0] == "ring"} == {"a": (0, False), "b": (2, False), "c": (4, False), "d": (6, True), "e": (8, False), "f": (10, True)}


def test_op7_keeps_all_digits_of_numbers(spark):
    long = "123456789012345678901234567890123456789012"
    same = {"100": "100", "1e2": "100", "100.0": "100", "1.0": "1", "-0.0": "0", long: long, "1.50": "1.5", "12.5e1": "125", "1e30": "1e+30", "1" + "0" * 30: "1e+30", "1E-7": "1e-7", "-0.0012": "-0.0012", "0." + long: "0." + long}
    whole = ["100", "1e2", "100.0", "1.0", "-0.0", long, "12.5e1", "1e30", "1" + "0" * 30]
    schema = "conv_id string, turn long, role string, content string, kind string, call_id string, name string, arguments string"
    bad = ["01", "1.", "+1", "1e", "--1", "1e99999999999999999999"]
    texts = ['"\\u0001i5"', '"\\u0001s"', '"1e2"', '"a\\\\\\"1e2"']
    values = [*same, *bad, *texts]
    rows = [("c", i, "user", None, "call", f"x{i}", "f", f'{{"b":[{{"d":{v},"c":1.0}}], "a" : {v}}}') for i, v in enumerate(values)]
    fields = {"f": [("a", "integer", True), ("b", "array", True)]}
    out = {r.turn: r for r in chat.link_calls(spark.createDataFrame(rows, schema), fields).collect()}
    for i, v in enumerate(values):
        want = same.get(v) or (v if v in texts else None)
        assert out[i].canonical_arguments == (f'{{"a":{want},"b":[{{"c":1,"d":{want}}}]}}' if want else None), v
        assert out[i].valid == (v in whole), v
    kinds = {"f": [("a", "string", True), ("b", "array", False)]}
    assert {r.turn for r in chat.link_calls(spark.createDataFrame(rows, schema), kinds).where("valid").collect()} == {i for i, v in enumerate(values) if v in texts}


def test_op4_one_large_component_costs_no_recall(spark):
    rng = np.random.default_rng(12)
    for large in (1.0, 1e25, 1e290):
        x = rng.standard_normal((1500, 16))
        x[700] *= large
        out = ann.nearest(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 20 == 0).collect()
        found = {}
        for r in out:
            found.setdefault(r.query_id, set()).add(r.vec_id)
        asked = np.arange(0, 1500, 20)
        with np.errstate(over="ignore"):
            score = x[asked] @ x.T
        score[np.arange(len(asked)), asked] = -np.inf
        best = np.argsort(-score, axis=1)[:, :20]
        assert np.mean([len(found[int(q)] & set(b.tolist())) / 20 for q, b in zip(asked, best, strict=True)]) >= 0.95, large


def test_the_largest_long_is_an_id_like_others(spark):
    top, low = (1 << 63) - 1, -(1 << 63)
    text = sentence(5, 60)
    for ids in ([top, None, 3], [top, None], [low, top, None], [low, 7, top]):
        docs = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
        least = min(i for i in ids if i is not None)
        got = ngram_join.link_documents(docs).collect()
        assert sorted([r.doc_id for r in got], key=repr) == sorted(ids, key=repr) and {r.component_id for r in got} == {least}
        removed = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_bytes(docs).collect()}
        assert {i for i, n in removed.items() if n == 0} == {least}
    alone = ngram_join.link_documents(spark.createDataFrame([(top, text), (None, sentence(6, 60))], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in alone} == {(top, top), (None, None)}


def test_groups_of_windows_follow_the_texts_and_not_the_tasks(spark, monkeypatch):
    """Each group writes to each bucket, so with groups for each task the shuffle grew with the square of the tasks."""
    seen, real = [], _windows._send
    monkeypatch.setattr(_windows, "_send", lambda strings, n, k, n_buckets: seen.append(n_buckets) or real(strings, n, k, n_buckets))
    rows = [(i, " ".join(f"w{(i % 7) * 31 + j}" for j in range(40)), None if i % 3 else f"s{i}") for i in range(60)] + [(60, None, "n"), (61, "", None)]
    found = []
    for parts in (2, 60):
        out = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts))
        found.append(sorted((tuple(r) for r in out.collect()), key=lambda r: r[0]))
    assert found[0] == found[1] and len(found[0]) == 62 and seen[0] == seen[1]


def test_a_group_is_finished_in_parts_and_not_in_several_times_its_bytes(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    texts = [sentence(i, 2000) if i % 50 else None for i in range(800)]
    size = sum(len(t.encode()) for t in texts if t)
    ids = np.arange(len(texts))
    one = pa.record_batch([pa.array(np.zeros(len(texts), np.int32)), pa.array(ids), pa.array(ids), pa.array(texts), pa.StructArray.from_arrays([pa.array(ids)], ["c0"])], ["dest", "id", "key", "text", "row"])
    group = pa.Table.from_batches(list(_windows._dealt(iter([one.slice(0, 300), one.slice(300)]))))
    where = np.flatnonzero(ids % 50)[::2]
    blob = _windows._pack(_windows._SPAN_TYPES, where, where, np.arange(len(where)), np.full(len(where), 10), np.full(len(where), 70))
    spans = pa.table([pa.array([0], pa.int32()), pa.array([blob], pa.binary())], ["dest", "blob"])
    names = ["row", "text", "n_units", "n_removed", "n_spans", "kept_sha256"]
    monkeypatch.setattr(_windows, "FINISHED", 1 << 17)
    tracemalloc.start()
    out = _windows._finish(names, False, True)(group, spans)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # marks of the whole group alone take four times its bytes
    assert peak < 2 * size, (peak, size)
    cut = set(where.tolist())
    for i, (t, now, gone) in enumerate(zip(texts, out["text"].to_pylist(), out["n_removed"].to_pylist(), strict=True)):
        want = t if i not in cut else (t.encode()[:10] + t.encode()[70:]).decode("utf-8", "ignore")
        assert now == want and gone == (60 if i in cut else 0)
    assert out["row"].to_pylist() == [{"c0": i} for i in range(len(texts))]


def test_postings_hold_few_copies_of_their_shingles():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 20, 260)) for _ in range(4000)]
    batches = [pa.record_batch([pa.array(range(a, a + 1000)), pa.array(texts[a : a + 1000])], ["_id", "_text"]) for a in range(0, 4000, 1000)]
    ngram_join.shingle_sets(pa.array(texts[:1]))
    tracemalloc.start()
    rows = [n for out in ngram_join._postings(5, 16)(iter([*batches, batches[0].slice(0, 0)])) for n in [out.num_rows]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a million shingles of eight bytes are sent together
    assert rows == [16] and peak < 64 << 20, peak


def test_op4_a_pair_of_old_neighbours_is_not_compared_again(spark, monkeypatch):
    """What a round compares follows what the last one changed: on a settled graph it finds nothing, and names no old edge as found."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 12)).astype(np.float32)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rep long, vec array<float>")
    monkeypatch.setattr(ann, "CELL", 64)
    kept = []
    monkeypatch.setattr(ann._shared, "written", lambda d, name, f=ann._shared.written: kept.append(f(d, name)) or kept[-1])
    _, graph = ann.build_graph(nodes, len(x), 12, degree=16, tables=2, rounds=16)
    lists = {r.rep: r.ids for r in graph.collect()}
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    best = np.argsort(-score, axis=1)[:, :16]
    assert np.mean([len(set(lists[i]) & set(best[i].tolist())) / 16 for i in range(len(x))]) >= 0.9
    # nothing is new any more, so a round's comparison has nothing to send
    last = kept[-1].select("dest", "old", "blob")
    assert kept[-1].agg(F.sum("fresh")).first()[0] == 0
    members = last.union(last.mapInArrow(ann._asked(8, 24), ann._MESSAGE)).groupBy("dest").applyInArrow(ann._members(16, 8, 24, 64, 16), ann._MESSAGE)
    assert members.groupBy("dest").applyInArrow(ann._local_join(8, 64, 16), ann._MESSAGE).count() == 0
