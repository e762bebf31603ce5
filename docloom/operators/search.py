"""Variant-insensitive search: by substring, by words within an index of tokens, by trigrams; and snippets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import normalise as N

# Letters that match one another in the original text, and what may stand between letters.
_SAME = [set("اأإآٱ"), set("يى"), set("ةه")]
_MARKS_BETWEEN = "[ؐ-ًؚ-ٰٟ]*"
ARTICLE = "ال"


def normalised_query(query: str) -> str:
    """A query as norm_search makes it; for the few words a user types."""
    s = query.translate(str.maketrans(N.ARABIC_DIGITS, N.DIGITS))
    s = re.sub(N.MARKS_AND_DIGITS, "", s).translate(str.maketrans(N.ALEFS + "ىة", "ا" * len(N.ALEFS) + "يه")).lower()
    return " ".join(s.split())


def search_substring(query: str, column: str = "search_text") -> Column:
    """Whether the normalised query occurs in a normalised text; no text matches an empty query."""
    q = normalised_query(query)
    return F.contains(F.col(column), F.lit(q)) if q else F.lit(False)


def search_trigram(query: str, column: str = "search_text") -> Column:
    """Whether every word of three letters or more occurs as a substring."""
    words = [w for w in normalised_query(query).split() if len(w) >= 3]
    out = F.lit(bool(words))
    for w in words:
        out = out & F.contains(F.col(column), F.lit(w))
    return out


def query_words(query: str) -> list[list[str]]:
    """The words of a query, each with its form behind the article; words of fewer than three letters are dropped."""
    words = (re.sub(r"[^\w؀-ۿ]+", "", w) for w in normalised_query(query).split())
    return [[w, ARTICLE + w] for w in words if len(w) >= 3]


def tokens(c: Column | str) -> Column:
    """The distinct words of a normalised text."""
    return F.array_distinct(F.filter(F.split(N.text(c), r"[^\p{L}\p{N}_؀-ۿ]+"), lambda w: w != ""))


def search_words(query: str, column: str = "search_text") -> Column:
    """Whether every word of the query starts a word of the text, with or without the article."""
    groups = query_words(query)
    words = tokens(column)
    out = F.lit(bool(groups))

    def some(plain: str, with_article: str) -> Column:
        return F.exists(words, lambda t: t.startswith(plain) | t.startswith(with_article))

    for forms in groups:
        out = out & some(*forms)
    return out


def number_or_text(query: str, by_text: Column, number: str = "decision_no") -> Column:
    """A query of digits only also matches decision numbers that hold it."""
    q = query.strip()
    return by_text | F.contains(N.text(number), F.lit(q)) if q.isdigit() else by_text


def build_token_index(docs: DataFrame, id: str = "doc_id", column: str = "search_text") -> DataFrame:
    """Distinct (token, id), to be written partitioned by token."""
    return docs.select(F.explode(tokens(column)).alias("token"), F.col(id))


def refresh_token_index(index: DataFrame, changed: DataFrame, id: str = "doc_id", column: str = "search_text") -> DataFrame:
    """The index with the postings of changed documents replaced."""
    return index.join(changed.select(id).distinct(), id, "left_anti").unionByName(build_token_index(changed, id, column))


def search_index(index: DataFrame, query: str, id: str = "doc_id") -> DataFrame:
    """Ids of the documents that hold every word of the query, from the index alone.

    One pass over the postings that start with any of the words (a pushed-down filter), one count per
    document; common words cost their postings once.
    """
    groups = query_words(query)
    if not groups:
        return index.select(id).limit(0)
    hits = [F.max(F.col("token").startswith(a) | F.col("token").startswith(b)).alias(f"w{i}") for i, (a, b) in enumerate(groups)]
    some = F.lit(False)
    for a, b in groups:
        some = some | F.col("token").startswith(a) | F.col("token").startswith(b)
    by = index.where(some).groupBy(id).agg(*hits)
    for i in range(len(groups)):
        by = by.where(F.col(f"w{i}"))
    return by.select(id)


def trigram_postings(docs: DataFrame, id: str = "doc_id", column: str = "search_text") -> DataFrame:
    """Distinct (gram, id) of every three characters of a text."""
    s = N.text(column)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))
    return docs.select(F.explode(F.array_distinct(grams)).alias("gram"), F.col(id)).where(F.length("gram") == 3)


def search_by_trigrams(postings: DataFrame, docs: DataFrame, query: str, id: str = "doc_id", column: str = "search_text") -> DataFrame:
    """The documents that hold every word of the query: candidates with all its trigrams, then a check of the text."""
    words = [w for w in normalised_query(query).split() if len(w) >= 3]
    grams = sorted({w[i : i + 3] for w in words for i in range(len(w) - 2)})
    if not grams:
        return docs.limit(0)
    near = postings.where(F.col("gram").isin(grams)).groupBy(id).agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return docs.join(near.select(id), id, "left_semi").where(search_trigram(query, column))


def _pattern(query: str) -> re.Pattern | None:
    q = re.sub(N.MARKS_AND_DIGITS, "", query.translate(str.maketrans(N.ARABIC_DIGITS, N.DIGITS)))
    letter = lambda x: next((f"[{''.join(sorted(s))}]" for s in _SAME if x in s), re.escape(x))
    words = [_MARKS_BETWEEN.join(map(letter, w)) for w in q.split()]
    return re.compile(r"\s+".join(words), re.IGNORECASE) if words else None


def snippets(query: str, column: str = "text", width: int = 60, limit: int = 3) -> Column:
    """Up to ``limit`` matches in the original text with their surroundings, the hit in « »; meant for one page of results."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        rx = _pattern(query)

        def around(t: str) -> list[str]:
            out = []
            for m in rx.finditer(t) if rx else ():
                a, b = max(0, m.start() - width), min(len(t), m.end() + width)
                shown = ("…" if a else "") + t[a : m.start()] + "«" + m.group() + "»" + t[m.end() : b] + ("…" if b < len(t) else "")
                out.append(shown.replace("\n", " ").strip())
                if len(out) == limit:
                    break
            return out

        return texts.map(around)

    return run(N.text(column))
