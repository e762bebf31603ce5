"""Readability of texts, and where a document goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.normalise import text

# Glyphs of broken encodings, and Arabic letters.
BROKEN = r"[\uFB50-\uFDFF\uFE70-\uFEFF\uE000-\uF8FF\u0180-\u024F]"
ARABIC = r"[\u0600-\u06FF]"
#: Texts of fewer characters are too short to judge.
LEAST = 200


def _unreadable(c: Column | str, most_broken: float) -> Column:
    s = text(c)
    broken, arabic = F.regexp_count(s, F.lit(BROKEN)), F.regexp_count(s, F.lit(ARABIC))
    n = F.length(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    both = broken + arabic
    return (n >= LEAST) & ((broken / F.greatest(both, F.lit(1)) > most_broken) | (both / n < 0.15))


def ocr_garbled(c: Column | str) -> Column:
    """Whether a text is unreadable: over 15 % broken glyphs among its letters, or hardly any letters."""
    return _unreadable(c, 0.15)


def text_layer_unreliable(c: Column | str) -> Column:
    """The same with 3 %: whether a text layer can be trusted."""
    return _unreadable(c, 0.03)


def visible_chars(c: Column | str, title: Column | str = "") -> Column:
    """Characters that are no white space, without those of the title."""
    count = lambda x: F.length(F.regexp_replace(x, r"(?U)\s", ""))
    return F.greatest(count(text(c)) - count(F.lit(title) if isinstance(title, str) else text(title)), F.lit(0))


def completeness(visible: Column, pages: Column) -> Column:
    """empty, partial or an empty string."""
    return F.when(visible < F.greatest(F.lit(200), 60 * pages), "empty").when((pages > 1) & (visible < 400 * pages), "partial").otherwise("")


def release_gate(leak_hits: Column, garbled: Column, visible: Column, pages: Column) -> Column:
    """Why a document is held back: leak, poor-ocr, empty, partial; empty if it is delivered."""
    return F.when(leak_hits > 0, "leak").when(garbled, "poor-ocr").otherwise(completeness(visible, pages))


# What a reviewer reads of each reason.
DETAILS = {"poor-ocr": "garbled OCR — manual review", "empty": "almost no text came back — a rerun retries it", "partial": "transcription stopped early — a rerun retries it"}
LEAK_DETAIL = " surviving name(s) — open the held file to review"


def quarantine_detail(reason: Column, leak_hits: Column) -> Column:
    """What a reviewer reads; hits are counted, never quoted."""
    leak = F.when(reason == "leak", F.concat(leak_hits.cast("string"), F.lit(LEAK_DETAIL)))
    return F.coalesce(leak, *[F.when(reason == k, F.lit(v)) for k, v in DETAILS.items()], F.lit(""))
