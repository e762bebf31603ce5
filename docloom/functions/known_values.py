"""Many known values in many texts: one pass of an automaton finds the values that a text may hold, and only those are checked.

Values are prepared once, in Spark: their variants, the patterns of these, and their letters alone. The letters of a text, with
white space and marks gone, go through an Aho-Corasick automaton of all variants' letters, whose cost follows the text and
what it holds and not the number of values. What the automaton finds is more than what the patterns match, never less.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import pii
from docloom.functions.normalise import collapse_leak, let, text

#: What the gate needs of a value: the letters of its variants and patterns of short ones, and its letters if they count without white space.
PREPARED = "array<struct<v:string,forms:array<struct<letters:string,pattern:string>>,own:string>>"

_automata: dict[tuple[str, str], object] = {}


@dataclass
class KnownValues:
    """A bounded list of values, longest first: (value, patterns, own, letters for the gate, letters for the redactor)."""

    rows: Broadcast
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _automaton(self, form: str):
        """Letters -> numbers of values; built once in each worker."""
        if (self.name, form) not in _automata:
            import ahocorasick

            made = ahocorasick.Automaton()
            for i, row in enumerate(self.rows.value):
                for letters in row[form]:
                    made.add_word(letters, (*made.get(letters, ()), i))
            if len(made):
                made.make_automaton()
            while len(_automata) > 3:
                del _automata[next(iter(_automata))]
            _automata[self.name, form] = made
        return _automata[self.name, form]

    def find(self, letters: str | None, form: str) -> list[int]:
        """The numbers of the values whose letters stand in these, in order."""
        automaton = self._automaton(form)
        if not letters or not len(automaton):
            return []
        return sorted({i for _, found in automaton.iter(letters) for i in found})


def prepare(values: DataFrame, column: str = "value") -> KnownValues:
    """Known values from a column; the caller bounds their number. Null, blank, short values and initials are never looked for."""
    one = values.select(F.explode(pii.pii_values(F.array(F.col(column)))).alias("v")).distinct()
    variants = F.filter(pii.name_variants(F.trim("v")), lambda x: F.trim(x) != "")
    forms = lambda fold: F.array_distinct(F.filter(F.transform(variants, fold), lambda x: x != ""))
    own = collapse_leak(F.trim("v"))
    rows = one.select(F.struct("v", F.transform(variants, pii.counted_form).alias("forms"), F.when(F.length(own) > pii.SHORT, own).alias("own")).alias("prepared"), forms(collapse_leak).alias("gate"), forms(pii.letters_alone).alias("redactor"))
    found = [r.asDict(recursive=True) for r in rows.collect()]
    found.sort(key=lambda r: (-len(r["prepared"]["v"]), r["prepared"]["v"]))
    return KnownValues(values.sparkSession.sparkContext.broadcast(found))


def with_candidates(delivered: Column | str, known: KnownValues) -> Column:
    """Struct of text, flat and near: the text as it came, without white space, and the prepared values that it may hold."""

    @F.pandas_udf(f"text string, flat string, near {PREPARED}")
    def near(bodies: pd.Series, letters: pd.Series) -> pd.DataFrame:
        rows = known.rows.value
        return pd.DataFrame({"text": bodies, "flat": letters, "near": [[rows[i]["prepared"] for i in known.find(x, "gate")] for x in letters]})

    return near(text(delivered), collapse_leak(delivered))


def leaks_of(candidates: Column) -> Column:
    """Struct of passed, hits and leaked for what ``with_candidates`` gave."""
    return pii.scanned(candidates["text"], candidates["flat"], candidates["near"])


def leak_scan_known(delivered: Column | str, known: KnownValues) -> Column:
    """As ``leak_scan`` with these values: struct of passed, hits and leaked."""
    return let(with_candidates(delivered, known), leaks_of)


def literal_known(delivered: Column | str, known: KnownValues) -> Column:
    """Sorted: which of these values stand in a text as they are written, letter by letter."""
    near = lambda c: F.filter(F.transform(c["near"], lambda x: x["v"]), lambda v: F.contains(c["text"], v))
    return let(with_candidates(delivered, known), lambda c: F.array_sort(near(c)))


def redact_known(c: Column | str, known: KnownValues, token: str = pii.TOKEN) -> Column:
    """As ``redact_names`` with these values: struct of text, replaced and hits."""

    @F.pandas_udf("text string, replaced array<string>, hits int")
    def run(bodies: pd.Series, letters: pd.Series) -> pd.DataFrame:
        values, out = known.rows.value, []
        for body, alone in zip(bodies, letters, strict=True):
            names = [values[i]["prepared"]["v"] for i in known.find(alone, "redactor")]
            out.append(pii.without_names(body, names, token) if names else (body, [], 0))
        return pd.DataFrame(out, columns=["text", "replaced", "hits"])

    return run(text(c), pii.letters_alone(text(c)))
