"""URL filters: allow and block rules in a broadcast trie over reversed host labels and path prefixes.

A rule names a host and a path. It fits its host and all subdomains, where the URL's path
starts with the rule's path. The longest fitting rule (host and path characters together,
then the longer host) decides; of an allow and a block rule of the same place, block wins.
A URL without a fitting rule gets the default verdict and no rule.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import _shared

#: So many rules, of so many characters together, may be broadcast; more are joined by key.
MAX_BROADCAST_RULES = 200_000
MAX_BROADCAST_CHARS = 32_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MATCH = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dicts: reversed host labels, then path segments; a node's ``None`` maps path tails to verdicts, by length of the tail.

    ``rules``: (verdict, host, path). All but the last piece of a path are whole segments;
    the last is a prefix of the URL's segment in its place.
    """
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        *segments, tail = path.split("/")
        for s in segments:
            node = node.setdefault("/" + s, {})
        tails = node.setdefault(None, {}).setdefault(len(tail), {})
        if tails.get(tail) != "block":
            tails[tail] = verdict
    return root


def _longest(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    best = None
    node, labels = trie, host.split(".")
    segments = path.split("/")
    for depth in range(1, len(labels) + 1):
        node = node.get(labels[-depth])
        if node is None:
            break
        at, below = node, 0
        of_host = ".".join(labels[-depth:])
        while True:
            # one look-up for each length that tails have here, however many tails there are
            for n, tails in at.get(None, {}).items():
                tail = segments[below][:n]
                verdict = tails.get(tail)
                if verdict is not None:
                    of_path = "/".join([*segments[:below], tail])
                    found = (len(of_host) + len(of_path), len(of_host), of_host + of_path, verdict)
                    best = found if best is None or found[:2] > best[:2] else best
            at = at.get("/" + segments[below])
            below += 1
            if at is None or below >= len(segments):
                break
    return best and best[2:]


def _by_trie(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf(_MATCH)
    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [_longest(trie.value, h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    return df.withColumn("match", match("url_host", "url_path"))


def _by_join(df: DataFrame, rules: DataFrame) -> DataFrame:
    """The same matches by a join: each host suffix and path prefix of a distinct URL place is a key."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    labels = F.split("url_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("url_path"))
    places = df.select("url_host", "url_path").distinct()
    keys = places.withColumn("host", F.explode(suffixes)).withColumn("n", F.explode(prefixes))
    keys = keys.withColumn("path", F.expr("substring(url_path, 1, n)"))
    ruled = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    best = (
        keys.join(ruled, ["host", "path"])
        .groupBy("url_host", "url_path")
        .agg(F.max(F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict")).alias("b"))
        .select("url_host", "url_path", F.struct("b.rule", "b.verdict").alias("match"))
    )
    return df.join(best, ["url_host", "url_path"], "left")


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict of each URL (columns of these names are replaced).

    ``rules``: (verdict, host, path); rules with a null part are ignored. Up to
    MAX_BROADCAST_RULES rules are broadcast as a trie, more are joined by key. A null or
    malformed URL has an empty host and path, no rule, and the default verdict. Rows are
    kept as they are, repeated ones too; an empty table gives an empty table.
    """
    rules = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path").dropna().distinct()
    n, chars = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
    keep = _shared.others(df, ["host", "path", "rule", "verdict"])
    u = _shared.column(url)
    placed = df.select(_shared.packed(keep).alias("row"), url_host(u).alias("url_host"), url_path(u).alias("url_path"))
    if n <= MAX_BROADCAST_RULES and chars <= MAX_BROADCAST_CHARS:
        out = _by_trie(placed, [tuple(r) for r in rules.collect()])
    else:
        out = _by_join(placed, rules)
    return out.select(
        *_shared.unpacked(keep),
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("match.rule").alias("rule"),
        F.coalesce(F.col("match.verdict"), F.lit(default)).alias("verdict"),
    )
