"""Rulings that review one another: keyed candidates, scores, best links, and cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import normalise as N
from docloom.operators.components import connected_components, stored


def level_rank(c: Column | str) -> Column:
    level = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.when(level == name, F.lit(i)) for i, name in enumerate(N.LEVELS, 1)], F.lit(0))


def with_keys(df: DataFrame, as_of_year: int) -> DataFrame:
    """``df`` with file_norm, date_norm and dec: always computed, never read from storage."""
    return df.withColumns({"file_norm": N.canon_file_no("file_no", as_of_year), "date_norm": N.canon_date("date"), "dec": N.strip(N.text("decision_no"))})


def _plain_facts(df: DataFrame, side: str, key: list[str], *more: Column) -> DataFrame:
    """What scoring needs, computed once per row before it is joined."""
    return df.select(
        *key,
        *more,
        "file_norm",
        "date_norm",
        "dec",
        F.array_join(N.file_components("file_no"), "/").alias(f"{side}_parts"),
        N.text("city").alias(f"{side}_city"),
        N.court_to_level("court").alias(f"{side}_court"),
    )


def _facts(df: DataFrame, side: str, key: list[str], *more: Column) -> DataFrame:
    """Facts with a row for each key that the row has."""
    # from a plain explode Spark infers a filter for rows with keys, which works them out a second time
    return _plain_facts(df, side, key, *more).withColumn("key", F.explode_outer(_keys("file_norm", "dec", "date_norm"))).where("key is not null")


def _keys(file: str, dec: str, date: str) -> Column:
    by_file = F.when(F.col(file) != "", F.struct(F.lit(0).alias("kind"), F.col(file).alias("a"), F.lit("").alias("b")))
    by_decision = F.when((F.col(dec) != "") & (F.col(date) != ""), F.struct(F.lit(1).alias("kind"), F.col(dec).alias("a"), F.col(date).alias("b")))
    return F.filter(F.array(by_file, by_decision), lambda k: k.isNotNull())


_OWN = {"doc_id": "child", "file_norm": "d_file", "date_norm": "d_date", "dec": "d_dec"}


def document_facts(docs: DataFrame, as_of_year: int, *keep: str) -> DataFrame:
    """child, child_rank, what linking reads of a document, and the columns to keep."""
    return _plain_facts(with_keys(docs, as_of_year), "d", ["doc_id", *keep], level_rank("level").alias("child_rank")).withColumnsRenamed(_OWN)


def reference_facts(refs: DataFrame, own: DataFrame, as_of_year: int) -> DataFrame:
    """doc_id, ref_ix, parent_rank and what linking reads of a reference, for references of documents with facts ``own``."""
    parents = own.select(F.col("child").alias("doc_id"), F.col("child_rank").alias("parent_rank"))
    return _plain_facts(with_keys(refs, as_of_year), "r", ["doc_id", "ref_ix"]).join(parents, "doc_id")


#: A parent is of a higher level than its child, unless a level is unknown.
_MAY_REVIEW = "parent_rank = 0 or child_rank = 0 or parent_rank > child_rank"


def _both_facts(docs: DataFrame, refs: DataFrame, as_of_year: int, *more: Column) -> tuple[DataFrame, DataFrame]:
    """The facts of documents and of references, with ``more`` columns of the references."""
    own = _facts(with_keys(docs, as_of_year), "d", ["doc_id"], level_rank("level").alias("child_rank")).withColumnsRenamed(_OWN)
    return own, _facts(with_keys(refs, as_of_year), "r", ["doc_id", "ref_ix"], *more)


def _pairs(ref: DataFrame, own: DataFrame) -> DataFrame:
    pairs = ref.join(own, "key").where("doc_id <> child")
    # a pair that agrees on the file number is left out of those that agree on the decision, so no distinct is needed
    return pairs.where((F.col("key.kind") == 0) | (F.col("file_norm") == "") | (F.col("file_norm") != F.col("d_file"))).drop("key")


def link_candidates(docs: DataFrame, refs: DataFrame, as_of_year: int) -> DataFrame:
    """doc_id, ref_ix, child, child_rank and both sides' facts: pairs that agree on the file number, or on decision number and date.

    One equi-join on keys that are not empty; pairs found by both come once.
    """
    own, ref = _both_facts(docs, refs, as_of_year)
    return _pairs(ref, own)


def ranked_candidates(docs: DataFrame, refs: DataFrame, as_of_year: int) -> DataFrame:
    """What ``rank_filter`` leaves of ``link_candidates``: parents' levels go with the references, so pairs are not shuffled."""
    parents = docs.select("doc_id", level_rank("level").alias("parent_rank"))
    own, ref = _both_facts(docs, refs.join(parents, "doc_id"), as_of_year, F.col("parent_rank"))
    return _pairs(ref, own).where(_MAY_REVIEW).drop("parent_rank")


def match_score(pairs: DataFrame) -> DataFrame:
    """``pairs`` with score and confidence (high, medium, low, none)."""
    both = lambda a, b: (F.col(a) != "") & (F.col(a) == F.col(b))
    file = both("file_norm", "d_file")
    fuzzy = (F.col("file_norm") != "") & (F.col("d_file") != "") & ~file & (F.col("r_parts") == F.col("d_parts"))
    dec, date = both("dec", "d_dec"), both("date_norm", "d_date")
    court = both("r_city", "d_city") | both("r_court", "d_court")
    score = F.when(file, 3).when(fuzzy, 1).otherwise(0) + F.when(dec, 2).otherwise(0) + F.when(date, 1).otherwise(0) + F.when(court, 1).otherwise(0)
    confidence = F.when(file & (dec | date) & court, "high").when(file | (dec & date & court), "medium").when(score >= 1, "low").otherwise("none")
    return pairs.withColumns({"score": score, "confidence": confidence})


def rank_filter(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose parent is of a higher level than the child, or where a level is unknown."""
    parent = docs.select("doc_id", level_rank("level").alias("parent_rank"))
    return pairs.join(parent, "doc_id").where(_MAY_REVIEW).drop("parent_rank")


def best_link(scored: DataFrame, *keep: str) -> DataFrame:
    """parent_doc, child_doc, confidence, score: each reference's best high or medium pair; of equal ones the smallest child.

    ``keep`` names columns that are returned too: ref_ix, by which a document's references are told apart.
    """
    # the smallest child of each score and confidence: plain minima, which are taken without sorting the pairs
    at = lambda score, confidence: F.min(F.when((F.col("score") == score) & (F.col("confidence") == confidence), F.col("child"))).alias(f"{confidence}_{score}")
    good = scored.where(F.col("confidence").isin("high", "medium"))
    top = good.groupBy("doc_id", "ref_ix").agg(*[at(score, c) for score in _SCORES for c in ("high", "medium")])
    high, medium = ([F.col(f"{c}_{score}") for score in _SCORES] for c in ("high", "medium"))
    first = [F.least(h, m) for h, m in zip(high, medium, strict=True)]
    confidence = F.coalesce(*[F.when(c.isNotNull(), F.when(c == h, "high").otherwise("medium")) for c, h in zip(first, high, strict=True)])
    score = F.coalesce(*[F.when(c.isNotNull(), F.lit(s)) for c, s in zip(first, _SCORES, strict=True)])
    return top.select(F.col("doc_id").alias("parent_doc"), F.coalesce(*first).alias("child_doc"), confidence.alias("confidence"), score.alias("score"), *keep)


#: The scores that a link may have, the best first.
_SCORES = range(7, 2, -1)
#: A key of more documents is not joined pair by pair.
DENSE = 100
#: How a reference and a document can meet: on the file number, on decision number and date, and on these with the parts of a file number.
_FILE, _DECISION, _PARTS = [("file_norm", "d_file")], [("dec", "d_dec"), ("date_norm", "d_date")], [("dec", "d_dec"), ("date_norm", "d_date"), ("r_parts", "d_parts")]


def _meeting_places(side: str, on: list[tuple[str, str]]) -> Column:
    """For a row of facts: all that a row of the other side may agree with it on beside the key, as (score, x, y, place, z).

    ``score`` is without the court, ``place`` whether a city (1) or a kind of court (2) agrees too, or neither (0).
    """
    dec, date = ("d_dec", "d_date") if side == "d" else ("dec", "date_norm")
    none = F.lit("")
    way = lambda score, x=none, y=none: F.struct(F.lit(score).alias("g"), x.alias("x"), y.alias("y"))
    has = lambda c: F.col(c) != ""
    places = [F.when(has(f"{side}_city"), F.struct(F.lit(1).alias("p"), F.col(f"{side}_city").alias("z"))), F.when(has(f"{side}_court"), F.struct(F.lit(2).alias("p"), F.col(f"{side}_court").alias("z")))]
    if on == _FILE:
        ways = [F.when(has(dec) & has(date), way(6, F.col(dec), F.col(date))), F.when(has(dec), way(5, F.col(dec))), F.when(has(date), way(4, none, F.col(date))), way(3)]
        places.append(F.struct(F.lit(0).alias("p"), none.alias("z")))
    else:
        # pairs that agree on decision and date alone are too weak to be links
        ways = [way(4 if on == _PARTS else 3)]
    kept = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return F.flatten(F.transform(kept(ways), lambda g: F.transform(kept(places), lambda p: F.struct(g["g"], g["x"], g["y"], p["p"], p["z"]))))


def _dense_links(own: DataFrame, ref: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """doc_id, ref_ix, child, score, confidence: pairs among which is the best of each reference, at most eight for each way to agree.

    Of the documents that agree with a reference in one way only their levels matter, and of each level the smallest document, or
    the second if the smallest is the reference's own. A pair that agrees in more ways is found in each of them; the score of the
    one that names all is its own, the others are lower and so never win.
    """
    keys = [r for r, _ in on]
    at = [*keys, "g", "x", "y", "p", "z"]
    first = F.row_number().over(Window.partitionBy(*at, "child_rank").orderBy("child"))
    few = own.select(*[F.col(d).alias(r) for r, d in on], "child", "child_rank", F.inline(_meeting_places("d", on))).withColumn("r", first).where("r <= 2").drop("r")
    met = ref.select(*keys, "doc_id", "ref_ix", "parent_rank", F.inline(_meeting_places("r", on))).join(few, at).where(f"doc_id <> child AND ({_MAY_REVIEW})")
    high = F.lit(on == _FILE) & (F.col("g") > 3) & (F.col("p") > 0)
    return met.select("doc_id", "ref_ix", "child", (F.col("g") + F.when(F.col("p") > 0, 1).otherwise(0)).alias("score"), F.when(high, "high").otherwise("medium").alias("confidence"))


def _links_on(own: DataFrame, ref: DataFrame, on: list[tuple[str, str]]) -> list[DataFrame]:
    """doc_id, ref_ix, child, score, confidence: the best link of each reference among the documents that it meets so, in tables."""
    # a file number's parts tell nothing where file numbers agree; without a place, pairs of one decision are no links
    unused = {"d_parts", "r_parts"} if on == _FILE else {"d_file", "file_norm"} if on == _PARTS else set()
    placed = lambda side: F.lit(on == _FILE) | (F.col(f"{side}_city") != "") | (F.col(f"{side}_court") != "")
    named = lambda df, side, names: df.where(placed(side)).where(" AND ".join(f"{c} <> ''" for c in names))
    own, ref = named(own, "d", [d for _, d in on]), named(ref, "r", [r for r, _ in on])
    renamed = {r: d for r, d in on}
    if on == _PARTS:
        own, ref = own.where("d_file <> ''"), ref.where("file_norm <> ''")
    keys = [d for _, d in on]
    asked = ref.select(*renamed).withColumnsRenamed(renamed).distinct()
    crowded = stored(own.select(*keys).join(asked, keys, "left_semi").groupBy(*keys).count().where(F.col("count") > DENSE).drop("count"))
    few = crowded.isEmpty()
    refs_in = lambda how: ref.join(crowded.withColumnsRenamed({d: r for r, d in on}), list(renamed), how)
    sparse, others = (ref, own) if few else (refs_in("left_anti"), own.join(crowded, keys, "left_anti"))
    pairs = sparse.drop(*unused).join(others.drop(*unused), [F.col(r) == F.col(d) for r, d in on]).where(f"doc_id <> child AND ({_MAY_REVIEW})")
    if on != _FILE:
        # pairs of one file number are found by it
        pairs = pairs.where("file_norm = '' OR file_norm <> d_file") if on == _DECISION else pairs.withColumns({"file_norm": F.lit("-"), "d_file": F.lit("+")})
    else:
        pairs = pairs.withColumns({"r_parts": F.lit(""), "d_parts": F.lit("")})
    best = lambda scored: stored(best_link(scored, "ref_ix").withColumnsRenamed({"parent_doc": "doc_id", "child_doc": "child"}))
    found = [best(match_score(pairs).select("doc_id", "ref_ix", "child", "score", "confidence"))]
    if not few:
        own, ref = own.join(crowded, keys, "left_semi"), refs_in("left_semi")
        found.append(best(_dense_links(own, ref, on)))
        if on == _DECISION:
            found += _links_on(own, ref, _PARTS)
    return found


def links(own: DataFrame, ref: DataFrame, *keep: str) -> DataFrame:
    """The best link of each reference of ``ref`` (``reference_facts``) among the documents of ``own`` (``document_facts``).

    Both are read many times and should be tables. References and documents meet in one way after the other, so the disk holds the
    shuffle of one way at a time. Keys of at most DENSE documents are joined pair by pair. For the others the work grows
    with their documents and references, not with the product of both.
    """
    found = [*_links_on(own, ref, _FILE), *_links_on(own, ref, _DECISION)]
    return best_link(reduce(DataFrame.unionByName, found), *keep)


def relink(docs: DataFrame, refs: DataFrame, as_of_year: int, *keep: str) -> DataFrame:
    """All edges between documents, whatever order they arrived in: the best link of each reference."""
    own = stored(document_facts(docs, as_of_year))
    return links(own, stored(reference_facts(refs, own, as_of_year)), *keep)


def connected_cases(docs: DataFrame, edges: DataFrame, as_of_year: int, *keep: str) -> DataFrame:
    """doc_id, case_id, review: documents that edges connect are one case. ``component``, the smallest member, may be kept.

    A case is named after the file number of its lowest member (then the smallest id), or its id. Its
    review is ``check`` if any edge is of low or medium confidence.
    """
    return cases_of(docs.select("doc_id", level_rank("level").alias("rank"), N.canon_file_no("file_no", as_of_year).alias("no")), edges, *keep)


def cases_of(docs: DataFrame, edges: DataFrame, *keep: str) -> DataFrame:
    """``connected_cases`` of documents (doc_id, rank, no) whose rank of level and file number are known."""
    comp = connected_components(edges, "parent_doc", "child_doc")
    known = docs.select("doc_id", F.when(F.col("rank") == 0, 9).otherwise(F.col("rank")).alias("rank"), "no")
    # read twice, once to be grouped and once to be named
    member = stored(known.join(comp, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).select("doc_id", "component", "rank", "no"))
    weak = edges.where(F.col("confidence").isin("low", "medium")).select(F.col("parent_doc").alias("node")).join(comp, "node").select("component", F.lit(True).alias("weak")).distinct()
    named = member.groupBy("component").agg(F.min(F.struct("rank", "doc_id", "no")).alias("m")).join(weak, "component", "left")
    case = named.select("component", F.concat(F.lit("C:"), F.coalesce(F.nullif("m.no", F.lit("")), F.col("m.doc_id").cast("string"))).alias("case_id"), F.when(F.col("weak"), "check").otherwise("ok").alias("review"))
    return member.join(case, "component").select("doc_id", "case_id", "review", *keep)


def case_summary(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per case: levels, courts, file numbers by level, what is missing, its documents.

    ``docs`` has case_id and review. Of several documents of one level the largest id speaks for it.
    """
    court = F.coalesce(F.nullif(N.text("court"), F.lit("")), N.text("level"))
    # references go to their documents first, so that documents and their cases are worked out and grouped once
    named = refs.select("doc_id", N.court_to_level("court").alias("_l")).where("_l <> ''")
    cited = named.groupBy("doc_id").agg(*[F.max(F.col("_l") == lv).alias(f"_cites{i}") for i, lv in enumerate(N.LEVELS)])
    by = docs.join(cited, "doc_id", "left").groupBy("case_id").agg(
        *[F.max_by(F.struct(court.alias("court"), N.text("file_no").alias("no")), F.when(F.col("level") == lv, F.col("doc_id"))).alias(f"_{i}") for i, lv in enumerate(N.LEVELS)],
        *[F.coalesce(F.bool_or(F.col("level") == lv), F.lit(False)).alias(f"_has{i}") for i, lv in enumerate(N.LEVELS)],
        F.min_by(N.text("category"), F.when(N.text("category") != "", F.col("doc_id"))).alias("category"),
        F.min_by(N.text("review"), F.when(N.text("review") != "", F.col("doc_id"))).alias("review"),
        F.array_sort(F.collect_list(F.col("doc_id").cast("string"))).alias("_docs"),
        *[F.coalesce(F.bool_or(f"_cites{i}"), F.lit(False)).alias(f"_cited{i}") for i in range(3)],
    )
    has = [F.col(f"_has{i}") for i in range(3)]
    known = [has[i] | F.col(f"_cited{i}") for i in range(3)]
    known = [known[0] | has[1] | has[2], known[1] | has[2], known[2]]
    pick = lambda conditions, values: F.filter(F.array(*[F.when(c, v) for c, v in zip(conditions, values, strict=True)]), lambda x: x.isNotNull())
    levels = [F.lit(lv) for lv in N.LEVELS]
    yes = lambda c: F.when(c, "نعم").otherwise("لا")
    number = lambda i: F.when(has[i], F.col(f"_{i}.no")).otherwise("")
    return by.select(
        "case_id",
        F.coalesce("category", F.lit("")).alias("category"),
        F.array_join(pick(has, levels), "، ").alias("levels_present"),
        F.array_join(pick(has, [F.col(f"_{i}.court") for i in range(3)]), " → ").alias("courts_passed"),
        number(0).alias("ibtidai_file"),
        number(1).alias("istinaf_file"),
        number(2).alias("naqd_file"),
        yes(known[1]).alias("appealed"),
        yes(known[2]).alias("cassated"),
        F.array_join(pick([k & ~h for k, h in zip(known, has, strict=True)], levels), "، ").alias("missing_levels"),
        F.array_join("_docs", "؛ ").alias("docs"),
        F.coalesce("review", F.lit("")).alias("review"),
    )


def case_corpus_filter(docs: DataFrame, corpus: str) -> DataFrame:
    """The documents of every case with a member from one folder."""
    return docs.join(docs.where(F.col("corpus") == corpus).select("case_id").distinct(), "case_id", "left_semi")


def link_keys(df: DataFrame, as_of_year: int, *ids: str) -> DataFrame:
    """ids and key: the keys by which a row of documents or references can meet one of the other side."""
    return _facts(with_keys(df, as_of_year), "k", list(ids)).select(*ids, "key")


def fact_keys(own: DataFrame) -> DataFrame:
    """key: ``link_keys`` of documents with facts."""
    return own.select(F.explode(_keys("d_file", "d_dec", "d_date")).alias("key"))


def links_for(edges: DataFrame) -> DataFrame:
    """doc_id, to, role, confidence: each edge from both of its ends."""
    down = edges.select(F.col("parent_doc").alias("doc_id"), F.col("child_doc").alias("to"), F.lit("reviews").alias("role"), "confidence")
    up = edges.select(F.col("child_doc").alias("doc_id"), F.col("parent_doc").alias("to"), F.lit("reviewed_by").alias("role"), "confidence")
    return down.unionByName(up)


def visible_links(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """Links whose other end is published."""
    return links.join(decisions.where("state = 'published'").select(F.col("doc_id").alias("to")), "to", "left_semi")


def replace_links(stored: DataFrame, incoming: DataFrame, reimported: DataFrame, clear_when_empty: bool = False) -> DataFrame:
    """``stored`` without links that touch a re-imported document, and with those of its new record.

    ``incoming``: doc_id, to, role, confidence. A document whose new record has no links keeps its old
    ones, unless ``clear_when_empty``.
    """
    touched = reimported.select("doc_id").distinct() if clear_when_empty else incoming.select("doc_id").distinct()
    kept = stored.join(touched.select(F.col("doc_id").alias("parent_doc")), "parent_doc", "left_anti").join(touched.select(F.col("doc_id").alias("child_doc")), "child_doc", "left_anti")
    reviews = F.col("role") == "reviews"
    new = incoming.select(F.when(reviews, F.col("doc_id")).otherwise(F.col("to")).alias("parent_doc"), F.when(reviews, F.col("to")).otherwise(F.col("doc_id")).alias("child_doc"), "confidence")
    return kept.select("parent_doc", "child_doc", "confidence").unionByName(new)
