"""Cross-tokenizer alignment, personal data and ranked search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import lexical_search, pii_spans, queries, token_alignment

NAMES = ["row", "id", "key", "text2", "pairs", "times", "copies", "n", "h", "m", "terms", "freqs", "q", "c0", "none", "a b", "dot.ted", "tick`ed"]


def named(df):
    return df.select("*", *[F.lit(f"mine-{c}").alias(c) for c in NAMES])


def texts_of(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b ", " ", "\n", "é", "▁", "'s", "12", "  ", "<s>", "<|endoftext|>", "日本", "\xa0", "word", "the ", "The river", "!", "\x1c", "ﬁ", "😀", "\t"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(n)]


# --- alignment


def plain_alignment(texts):
    """Every document's columns, from whole texts, one token at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(token_alignment.FILE_A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=token_alignment.FILE_B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    counts, rows = Counter(), []
    for t in texts:
        rows.append(None)
        if not t:
            continue
        whole = (" " + t).encode()
        a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
        raw_a = [bytes(of[c] for c in first.id_to_token(i)) for i in a]
        raw_b = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            continue
        spans = []
        for raw in (raw_a, raw_b):
            at, out = 0, []
            for x in raw:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [",".join(str(i) for i, (x, y) in zip(a, spans[0], strict=True) if s <= x and y <= e) + "|" + ",".join(str(i) for i, (x, y) in zip(b, spans[1], strict=True) if s <= x and y <= e) for s, e in zip([0, *cuts], cuts, strict=False)]
        links = [(i, j) for i, (x, y) in zip(a, spans[0], strict=True) for j, (v, w) in zip(b, spans[1], strict=True) if x < w and v < y]
        counts.update(links)
        rows[-1] = (len(a), len(b), len(groups), links, ";".join(groups))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(r[4].encode()).hexdigest()) for r in rows]


COLUMNS = [*token_alignment.MEASURES, "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [token_alignment.MAX_PAIRS, 3])
def test_alignment_equals_a_plain_version(spark, monkeypatch, most):
    """Repeated texts, nulls, texts that do not come back, both ways of joining the counts."""
    monkeypatch.setattr(token_alignment, "MAX_PAIRS", most)
    texts = [*texts_of(1, 120), None, "", " ", "  a", "the river " * 60, "x" * 500, *["the river and the river"] * 40, "Ωmega ß"]
    docs = named(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).repartition(3)
    out = token_alignment.align_documents(docs, with_groups=True)
    assert out.columns == [*docs.columns, *COLUMNS, "groups"]
    got = {r.doc_id: r for r in out.collect()}
    for i, want in enumerate(plain_alignment(texts)):
        assert tuple(got[i][c] for c in COLUMNS) == want, texts[i]
        assert got[i].groups_sha256 == (hashlib.sha256(got[i].groups.encode()).hexdigest() if got[i].groups else "")
        assert got[i]["tick`ed"] == "mine-tick`ed" and got[i].text == texts[i]


def test_alignment_of_tables_without_texts(spark):
    shape = "doc_id long, text string, n_a string"
    assert token_alignment.align_documents(spark.createDataFrame([], shape)).count() == 0
    rows = token_alignment.align_documents(spark.createDataFrame([(None, None, "x"), (None, None, "x"), (1, "", "y")], shape)).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in rows] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_stretches_that_are_not_kept_are_tokenised_again(monkeypatch):
    from pathlib import Path

    aligner = token_alignment.Aligner(*(Path(f).read_bytes() for f in (token_alignment.FILE_A, token_alignment.FILE_B)))
    texts = texts_of(7, 200)
    kept = aligner.measure(texts)
    size = len(aligner.number)
    again = aligner.measure(texts[::-1])
    assert kept.groups == again.groups[::-1] and len(aligner.number) == size
    monkeypatch.setattr(token_alignment, "MAX_KEPT", 0)
    other = texts_of(8, 200)
    new = aligner.measure(other)
    assert len(aligner.number) == size and new.groups == aligner.measure(other).groups


def test_op11_query_equals_a_plain_version(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 700 or text is null").collect()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_token_alignment(spark, str(tmp_path)).collect()}
    assert got == dict(zip([r.doc_id for r in rows], plain_alignment([r.text for r in rows]), strict=True))


# --- personal data


def plain_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(map(str.isdigit, m[0])) <= 15]


def base(spans):
    return [s for s in spans if s[0] in pii_spans.BASE_KINDS]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    pieces = [*"0123456789" * 3, *"..@@+--  ab%é_()A", "4111 1111 1111 1111", "255.1.0.9", "+1 (201) 555-0199", "a.b@c.de", "日", "😀"]
    for _ in range(20_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(3, 40)))
        assert base(pii_spans.spans_of(t.encode())) == plain_base(t), t


def test_added_kinds():
    cases = {
        "IBAN: DE89 3704 0044 0532 0130 00, thanks": [("account", 6, 33)],
        "iban DE88 3704 0044 0532 0130 00": [],
        "Account no: 12-3456-789.": [("account", 12, 23)],
        "on account of 123456 people": [],
        "passport number AB1234567 é": [("account", 16, 25)],
        "é lives at 12 Old Mill Lane in town": [("address", 11, 27)],
        "Main Street 12; the lane; 5 lane": [],
        "see ftp://joe:s3cret@files.example/x": [("login", 10, 20)],
        "see http://example.com/a@b": [],
        "é joe.doe (at) mail [dot] example [dot] org": [("masked_email", 2, 43)],
        "meet me (at) noon": [],
    }
    for text, want in cases.items():
        assert [s for s in pii_spans.spans_of(text.encode()) if s[0] not in pii_spans.BASE_KINDS] == want, text


def test_long_runs_are_read_once():
    """A million digits, dots, local parts and signs: what a parser has read is not read again."""
    for run in ("1" * 10**6, "1." * 10**6, "1 " * 10**6, "a" * 10**6 + "@", "a@" * 10**5, "+1 " * 10**5, "://a" * 10**5, "iban " * 10**5, "(at)a" * 10**5):
        assert pii_spans.spans_of((run + " é a@b.c").encode())[0] == ("email", len(run) + 3, len(run) + 8)


def test_private_data_in_tables(spark):
    """Nulls, empty and long texts, repeats, clashing names; redaction; an empty table."""
    long = "x " * 200_000 + "a@b.c " + "1" * 1500 + " é 10.0.0.1"
    rows = [(1, None), (2, ""), (3, long), (None, "é a@b.c"), (None, "é a@b.c"), (4, "a@b.c@d.e, +1 (201) 555-0199; 4111 1111 1111 1111; 300.1.1.1.1.1.1")]
    docs = named(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("mine"))).repartition(2)
    found = pii_spans.find_private(docs)
    assert found.columns == [*[c for c in docs.columns if c != "spans"], "spans"]
    got = [(r.doc_id, r.text, [tuple(s) for s in r.spans]) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, t, plain_base(t or ""))) for i, t in rows)
    clean = {(r.doc_id, r.text) for r in pii_spans.find_private(docs, redact=True).where("doc_id is null or doc_id <> 3").collect()}
    assert clean == {(1, None), (2, ""), (None, "é [EMAIL]"), (4, "[EMAIL]@d.e, [PHONE]; [CARD]; 300.1.1.1.1.1.1")}
    assert pii_spans.find_private(docs.limit(0), redact=True).count() == 0


def test_op12_query_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_pii_spans(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_base(texts[r.doc_id])
        listed = [":".join(map(str, s)) for s in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii_spans.BASE_KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x.split(":")[0] in pii_spans.BASE_KINDS] == listed


# --- ranked search


def plain_ranking(docs, items, k=10):
    terms = lambda t: [x.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, Counter(w), len(w)) for i, w in bags if w]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(x for _, c, _ in bags for x in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for i, c, n in bags:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def search_case(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "Über", "日本", "X1"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    docs += [(1000 - i, "w1 w2, W3 w3") for i in range(60)] + [(2000, None), (2001, ""), (2002, "..."), (None, "w1 w2 w3 w3"), (None, "w9"), (5, "w1 w2"), (5, "w1 w2"), (2003, "w7 " * 5000)]
    items = [(f"i{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(12)]
    items += [("i3", "w1 w2 w3"), ("i3", "w1 w2 w3"), (None, "w3"), ("none", "nothing here"), ("null", None), ("empty", " ")]
    return docs, items


@pytest.mark.parametrize("block", [lexical_search.MAX_TERMS, 20])
def test_ranking_equals_a_plain_version(spark, monkeypatch, block):
    """Classes of copies, ties, rows without an id, repeated rows of both tables, and items in one or in several blocks."""
    monkeypatch.setattr(lexical_search, "MAX_TERMS", block)
    monkeypatch.setattr(lexical_search, "CELLS", 500)
    docs, items = search_case(4)
    left = named(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5)
    out = lexical_search.rank_documents(left, named(spark.createDataFrame(items, "item_id string, text string")))
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_ranking(docs, items)


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "w1")], "doc_id long, text string"), spark.createDataFrame([("a", "w1")], "item_id string, text string")
    for left, right in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), items)):
        out = lexical_search.rank_documents(left, right)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
