"""Text normalisers and keys. Each of the eight normalisers differs from the others on purpose.

All are built-in column expressions; a null is treated as the empty string, which is the missing value
throughout this library.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that are dropped, and letters and digits that stand for one another.
MARKS = r"[ؐ-ؚـً-ٰٟ]"
MARKS_AND_DIGITS = r"[ؐ-ؚـً-ٰ]"
HEADNOTE_MARKS = r"[ـً-ْٰ‏‎]"
ALEFS = "أإآٱ"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
DIGITS = "0123456789"
LOOKALIKES = ("یکەۀ", "يكهه")
UNKNOWN = "غير محدد"

_SPACES = r"(?U)\s+"


def text(c: Column | str) -> Column:
    """The column as a string that is never null."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return _sub(c, r"(?U)^\s+|\s+$")


def collapse_spaces(c: Column) -> Column:
    # a single space is one already, so only other white space and runs of it are replaced
    return F.trim(_sub(c, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def _fold(c: Column, alefs: str, ya: bool = True) -> Column:
    return F.translate(c, alefs + ("ى" if ya else ""), "ا" * len(alefs) + ("ي" if ya else ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_search(c: Column | str) -> Column:
    """For the search index: ASCII digits, no marks, one alef, ya and ha, lower case, single spaces."""
    s = _sub(F.translate(text(c), ARABIC_DIGITS, DIGITS), MARKS_AND_DIGITS)
    return collapse_spaces(F.lower(F.translate(_fold(s, ALEFS), "ة", "ه")))


def norm_field(c: Column | str) -> Column:
    """For fields of a ruling: no marks, ASCII digits (Arabic and Persian), Persian letters replaced, single spaces."""
    into = F.translate(_sub(text(c), MARKS), ARABIC_DIGITS + PERSIAN_DIGITS + LOOKALIKES[0] + ALEFS + "ى", DIGITS * 2 + LOOKALIKES[1] + "ا" * len(ALEFS) + "ي")
    return collapse_spaces(into)


def norm_category(c: Column | str) -> Column:
    """For categories: no marks, one alef (but not its wasla form), one ya, single spaces."""
    return collapse_spaces(_fold(_sub(text(c), MARKS_AND_DIGITS), "أإآ"))


def norm_eval(c: Column | str) -> Column:
    """For scoring: ASCII digits, no marks, one alef and ya, no white space at all."""
    return _sub(_fold(_sub(F.translate(text(c), ARABIC_DIGITS, DIGITS), MARKS_AND_DIGITS), "أإآ"), _SPACES)


def collapse_leak(c: Column | str) -> Column:
    """For the leak gate: no marks, one alef (every form) and ya, no white space at all."""
    return _sub(_fold(_sub(text(c), MARKS), ALEFS), _SPACES)


def strip_diac(c: Column | str) -> Column:
    """No marks, one alef and ya; spaces stay."""
    return _fold(_sub(text(c), MARKS), "أإآ")


def theme_key(c: Column | str) -> Column:
    """A subject's key: no marks, one alef, no leading article before three letters or more."""
    return collapse_spaces(_sub(_fold(_sub(text(c), HEADNOTE_MARKS), ALEFS, ya=False), r"^ال(?=\S{3})"))


def loose_key(c: Column | str) -> Column:
    """As theme_key, but the article goes at the start of any word."""
    return collapse_spaces(_sub(_fold(_sub(text(c), HEADNOTE_MARKS), ALEFS, ya=False), r"(?<![\p{L}\p{N}_])ال(?=\S{3})"))


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)(\d+)"), F.lit(1))


def canon_file_no(c: Column | str, as_of_year: int) -> Column:
    """A file number's digits with ``/`` between; a two-digit year at the end of three parts or more is written in full.

    ``as_of_year``: two-digit years up to this one are of its century, later ones of the century before.
    """
    s = _sub(F.trim(_sub(text(c), r"(?U)[^\d/\-\s]")), r"(?U)[\-\s]+", "/")
    s = _sub(_sub(s, "/+", "/"), "^/|/$")

    def dated(s: Column, parts: Column) -> Column:
        last = F.element_at(parts, -1)
        short = (F.size(parts) >= 3) & last.rlike(r"^[0-9]{2}$") & ~F.exists(parts, lambda p: p.rlike(r"^(19|20)[0-9]{2}$"))
        century = F.when(last.try_cast("int") <= as_of_year % 100, F.lit("20")).otherwise("19")
        full = F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.concat(century, last)))
        return F.when(short, F.array_join(full, "/")).otherwise(s)

    return let(s, lambda x: let(F.split(x, "/"), lambda parts: dated(x, parts)))


def file_components(c: Column | str) -> Column:
    """The distinct digit runs of a file number, sorted."""
    return F.array_sort(F.array_distinct(digit_runs(text(c))))


def canon_date(c: Column | str) -> Column:
    """``YYYY|a|b`` of a date with a four-digit year, a and b being its other two parts sorted as strings."""

    def dated(runs: Column, year: Column) -> Column:
        rest = F.array_sort(F.slice(F.filter(runs, lambda n: n != year), 1, 2))
        # with one other part only there is no pair; the part stands for both places in order
        pair = let(rest, lambda r: F.concat(F.array_repeat(F.lit(""), 2 - F.size(r)), r))
        return F.when((F.size(runs) >= 3) & year.isNotNull(), F.concat_ws("|", year, F.array_join(pair, "|"))).otherwise("")

    return let(digit_runs(text(c)), lambda runs: let(F.get(F.filter(runs, lambda n: F.length(n) == 4), F.lit(0)), lambda year: dated(runs, year)))


def year_of(c: Column | str) -> Column:
    """The first run of four digits that starts with 19 or 20."""
    return F.coalesce(F.get(F.filter(digit_runs(text(c)), lambda n: (F.length(n) == 4) & n.rlike("^(19|20)")), F.lit(0)), F.lit(""))


NUMBER = r"[0-9]+(?:\s*[/\-–]\s*[0-9]+){0,3}"
FILE_NUMBER = r"[0-9]+(?:\s*[/\-–]\s*[0-9]+){1,3}"


def tidy_number(c: Column | str) -> Column:
    """Without spaces around the separators of a number."""
    return _sub(F.trim(text(c)), r"\s*([/\-–])\s*", "$1")


def split_file_numbers(c: Column | str) -> Column:
    """The file numbers of a joined run; one empty string where there is none."""
    found = F.regexp_extract_all(text(c), F.lit(f"({FILE_NUMBER})"), F.lit(1))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(F.transform(found, lambda x: tidy_number(x)))


def norm_court(c: Column | str) -> Column:
    """No marks, one alef and ya, the letter ba as a space, single spaces."""
    return collapse_spaces(F.translate(strip_diac(c), "ب", " "))


# Cities in the order in which they are looked for.
CITIES = [
    "الرباط", "الدار البيضاء", "البيضاء", "مراكش", "فاس", "طنجة", "أكادير", "اكادير",
    "وجدة", "مكناس", "الحسيمة", "العيون", "كلميم", "بني ملال", "سطات", "الرشيدية",
    "تازة", "الناظور", "خريبكة", "سلا", "القنيطرة", "تطوان", "ورزازات", "الجديدة",
]
FIRST_INSTANCE, APPEAL, CASSATION = "ابتدائي", "استئناف", "نقض"
LEVELS = [FIRST_INSTANCE, APPEAL, CASSATION]


def _fold_str(s: str) -> str:
    return s.translate(str.maketrans("أإآى", "اااي"))


def first_contained(c: Column, pairs: Sequence[tuple[str, str]], otherwise: str = "") -> Column:
    """The value of the first pair, in order, whose key is contained in ``c``."""
    return let(c, lambda x: F.coalesce(*[F.when(F.contains(x, F.lit(k)), F.lit(v)) for k, v in pairs], F.lit(otherwise)))


def city_of(c: Column | str) -> Column:
    """The first city of the list that the name contains."""
    return first_contained(strip_diac(c), [(_fold_str(x), x) for x in CITIES])


def _level(c: Column, first: Sequence[str]) -> Column:
    top = [("النقض", CASSATION), ("المجلس الاعلي", CASSATION), ("الاستئناف", APPEAL), ("الاستناف", APPEAL)]
    return first_contained(c, [*top, *((x, FIRST_INSTANCE) for x in first)])


def court_to_level(c: Column | str) -> Column:
    """The level of a court by its name."""
    return _level(strip_diac(c), ["الابتدائية", "الادارية", "التجارية"])


def level_from_text(c: Column | str) -> Column:
    """The level by the wording of a ruling's header."""
    return _level(strip_diac(c), ["الابتدائية", "المحكمة التجارية", "المحكمة الادارية"])


def court_kind(c: Column | str) -> Column:
    """top, appeal, first-instance or unknown."""
    s = F.replace(norm_field(c), F.lit(" "), F.lit(""))
    return (
        F.when(s.rlike("النقض|المجلسالاعلي"), "top")
        .when(s.rlike("ست[ئي]?ناف"), "appeal")
        .when(s.rlike("بتدائي|المركزالقضائي|(?:التجارية|الادارية)$"), "first-instance")
        .otherwise("unknown")
    )


def sort_key(date: Column | str, decision_no: Column | str) -> Column:
    """``YYYYMMDD`` of a ``DD/MM/YYYY`` date and the first six digits of the decision number, padded on the left."""
    parts, n = F.split(text(date), "/"), _sub(text(decision_no), "[^0-9]")
    day = F.when(F.size(parts) == 3, F.concat(F.get(parts, 2), F.get(parts, 1), F.get(parts, 0))).otherwise("00000000")
    return F.concat(day, F.substring(F.when(F.length(n) < 6, F.lpad(n, 6, "0")).otherwise(n), 1, 6))


def title_for(court: Column | str, chamber: Column | str) -> Column:
    """Court and chamber, without parts that are empty or unknown."""
    parts = F.filter(F.array(text(court), text(chamber)), lambda p: ~p.isin("", UNKNOWN))
    return F.array_join(parts, " — ")


def excerpt(c: Column | str, most: int = 400) -> Column:
    """The first ``most`` characters, cut at the last space if that is past 60 %."""
    s = text(c)
    head = F.substring(s, 1, most)
    at = most - F.instr(F.reverse(head), " ")  # characters before the last space
    has = F.contains(head, F.lit(" ")) & (at > most * 0.6)
    cut = F.when(has, F.substring(head, F.lit(1), at.cast("int"))).otherwise(head)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(_sub(cut, r"(?U)\s+$"), F.lit("…")))


def xml_safe(c: Column | str) -> Column:
    """Without control characters that XML forbids."""
    return _sub(text(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")


def collapse_repeat_lines(c: Column | str) -> Column:
    """Without lines that equal the line before."""
    lines = F.split(text(c), "\n")
    kept = F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))
    return F.array_join(kept, "\n")


#: A line of at most so many characters is a header of its own; with a cue, at most so many.
HEADER_CHARS, HEADER_CUE_CHARS = 18, 35
# Wording that marks a header line.
HEADER_CUES = (
    "باسم جلالة|لهذه الأسباب|من أجله|المملكة المغربية|المجلس الأعلى|رفض الطلب|"
    "نقض وإحالة|نقض وإبطال|عدم القبول|القرار عدد|قرار رقم|قرار محكمة النقض|محكمة النقض"
)


def reflow_lines(c: Column | str) -> Column:
    """Paragraphs (struct of header, text): short lines stand alone, longer ones are joined up to an empty line."""
    lines = F.transform(F.split(text(c), "\n"), strip)
    header = lambda x: (F.length(x) <= HEADER_CHARS) | ((F.length(x) <= HEADER_CUE_CHARS) & x.rlike(HEADER_CUES))
    part = lambda h, t: F.array(F.struct(h.alias("header"), t.alias("text")))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), part(F.lit(False), F.concat_ws(" ", last["text"], x)))
        ends = F.concat(done, part(F.lit(None).cast("boolean"), F.lit("")))  # an empty line, taken out below
        open_ = ~header(x) & F.coalesce(~last["header"], F.lit(False))
        return F.when(x == "", ends).when(open_, joined).otherwise(F.concat(done, part(header(x), x)))

    return F.filter(F.aggregate(lines, F.array().cast("array<struct<header:boolean,text:string>>"), step), lambda p: p["header"].isNotNull())


def align_pages(pages: Column, expected: Column | int) -> Column:
    """The first ``expected`` pages, filled up with empty ones."""
    n = F.lit(expected) if isinstance(expected, int) else expected
    return F.slice(F.concat(pages, F.array_repeat(F.lit(""), n)), F.lit(1), n)


def split_halves(c: Column | str) -> Column:
    """Two parts: cut at the last line break of the first half if past a quarter, else the first of the second half, else in the middle."""
    s = text(c)
    mid = F.floor(F.length(s) / 2).cast("int")
    left = F.substring(s, F.lit(1), mid)
    before = F.when(F.contains(left, F.lit("\n")), mid - F.instr(F.reverse(left), "\n")).otherwise(-1)
    after = F.call_function("locate", F.lit("\n"), s, mid + 1) - 1
    found = F.when(before < F.floor(F.length(s) / 4), after).otherwise(before)
    at = F.when(found <= 0, mid).otherwise(found).cast("int")
    return F.array(F.substring(s, F.lit(1), at), F.substring(s, at + 1, F.length(s)))


def head_tail_trim(c: Column | str, head: int = 7000, tail: int = 3000) -> Column:
    """The first and last characters of a long text; runs of empty lines count as one."""
    s = _sub(strip(text(c)), r"\n{3,}", "\n\n")
    return F.when(F.length(s) <= head + tail, s).otherwise(F.concat(F.substring(s, 1, head), F.lit("\n\n[...]\n\n"), F.substring(s, -tail, tail)))


def token_cost(tokens_in: Column, tokens_out: Column, cached: Column, price_in: float, price_out: float, price_cached: float) -> Column:
    """Price of a call; prices are per million tokens, cached input at its own price."""
    return ((tokens_in - cached) * price_in + cached * price_cached + tokens_out * price_out) / 1e6
