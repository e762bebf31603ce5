"""Mixing sources to target weights by entropy balancing.

Documents get rates exp(lambda_s * size / mean size of source s), at most ``cap``, that stay closest
to one copy each (in relative entropy) while the expected words of each source equal its target. The
multipliers solve a convex dual with one dimension per source; safeguarded Newton steps run as Spark
aggregations over the counts of documents by (source, size). Rates are then rounded into whole copies
so that the words taken follow the rates' sum: within each source's buckets, from the longest document
to the shortest, the error so far decides whether a rate is rounded up or down.

A null text has size 0. A null source is a source of its own, the last one. Repeated rows are
documents of their own. A document without words is taken once and adds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import _shared

#: Rounding works on groups of about so many documents of one source.
BUCKET_ROWS = 2_000
#: Up to so many sources are sent to every task; more are joined by key.
MAX_BROADCAST_SOURCES = 200_000


def word_count(text: Column) -> Column:
    """How many runs of other characters than ASCII white space the text has (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _numbered(by: DataFrame) -> DataFrame:
    """``by`` with s, the place of each source in the order of code points, null last: the rows of the ranges before, and the place within one."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = _shared.cut(by.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    # one row for each range of sources
    before = sums.select("part", (F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("within", within).join(F.broadcast(before), "part").withColumn("s", F.col("before") + F.col("within")).drop("part", "rows", "before", "within")


def source_targets(sizes: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), rounds: int = 1000) -> DataFrame:
    """s, source, n, source_size, smallest, target of each source of ``sizes`` (source, size).

    Sources in the order of their code points, null last, weigh as ``weights`` repeats. Together
    they share the sum of all sizes by weight; a target stops at ``cap`` times its source's size
    and the excess is shared again by weight, until none is above: one aggregation for each time.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    limited = _shared.cut(_numbered(by).withColumn("w", weight).withColumn("limit", cap * F.col("source_size")))
    total = float(limited.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    for _ in range(rounds):
        # the share of one unit of weight among the sources that are not stopped yet
        above = F.col("limit") < F.lit(level) * F.col("w") if stopped >= 0 else F.lit(False)
        r = limited.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0.0)).alias("got"), F.sum(F.when(~above, F.col("w"))).alias("w")).first()
        if r["n"] == stopped or not r["w"]:
            break
        level, stopped = (total - r["got"]) / r["w"], r["n"]
    else:
        raise RuntimeError(f"targets did not settle in {rounds} rounds")
    target = F.least(F.col("limit"), F.lit(level) * F.col("w")).cast("double")
    return limited.select("s", "source", "n", F.col("source_size").cast("long").alias("source_size"), "smallest", target.alias("target"))


def newton_rates(counts: DataFrame, targets: DataFrame, cap: float = 3.0, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """``targets`` with ``lam``, the multiplier of each source.

    ``counts``: (s, size, n) documents by source and size, size > 0. Each round is one aggregation
    over the counts; a step that leaves the bracket around the root halves it instead. Sources
    whose target is their limit have all rates at ``cap``. Raises if a source is not solved after ``rounds``.
    """
    top = float(np.log(cap))
    mean = F.col("source_size") / F.col("n")
    start = targets.withColumns({"mean": mean, "lam": F.lit(0.0), "lo": F.coalesce(F.least(F.log(F.col("target") / F.col("source_size")) * mean / F.col("smallest"), F.lit(0.0)), F.lit(0.0)) - 1e-9, "hi": F.coalesce(top * mean / F.col("smallest"), F.lit(0.0)) + 1e-9})
    full = (F.col("source_size") == 0) | (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12))
    state = _shared.cut(start.withColumns({"lam": F.when(full, F.col("hi")).otherwise(F.col("lam")), "done": full}))
    carried = state.columns
    for left in range(rounds, -1, -1):
        if state.where(~F.col("done")).isEmpty():
            break
        if not left:
            raise RuntimeError(f"rates were not solved in {rounds} rounds")
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * z, F.lit(top)))
        words = F.col("c") * F.col("size") * rate
        grown = (
            counts.select("s", "size", F.col("n").alias("c"))
            .join(state.where(~F.col("done")).select("s", "lam", "mean"), "s")
            .groupBy("s")
            .agg(F.sum(words).alias("got"), F.sum(F.when(F.col("lam") * z < top, words * z).otherwise(0.0)).alias("slope"))
        )
        off = F.col("got") - F.col("target")
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (step > lo) & (step < hi)
        moved = F.when(inside, step).otherwise((lo + hi) / 2)
        here = F.col("done") | (F.abs(off) <= tolerance * F.col("target"))
        new = {"lam": F.when(here, F.col("lam")).otherwise(moved), "lo": F.when(F.col("done"), F.col("lo")).otherwise(lo), "hi": F.when(F.col("done"), F.col("hi")).otherwise(hi), "done": F.coalesce(here, F.lit(False))}
        state = _shared.cut(state.join(grown, "s", "left").withColumns(new).select(*carried))
    return state


def _round(batch: pa.Table) -> pa.Table:
    size, rate = batch["size"].to_numpy().astype(float), batch["rate"].to_numpy()
    order = np.lexsort((batch["h"].to_numpy(), -size))
    copies, owed = np.zeros(len(size), np.int64), 0.0
    low = np.floor(rate + 1e-9)
    for i in order.tolist():
        n, r = size[i], rate[i]
        owed += r * n
        c = low[i]
        if r - c > 1e-9 and owed - c * n > n / 2:
            c += 1
        copies[i] = c
        owed -= c * n
    return batch.append_column("copies", pa.array(copies)).drop_columns(["s", "bucket", "h"])


def mix_sources(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), with_text: bool = False) -> DataFrame:
    """size, source_size, target, rate, copies and taken of each row of ``docs``.

    Returned beside the id, or beside all columns of ``docs`` if ``with_text``. The columns
    that are added replace columns of the same names; columns of any other names are kept.
    Rows are told apart by a hash of id, source and text, never by where they are read from, so reruns agree.
    """
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    kept = _shared.others(docs, added) if with_text else [id]
    c = _shared.column
    keyed = docs.select(_shared.packed(kept).alias("row"), c(source).alias("source"), word_count(c(text)).alias("size"), F.xxhash64(c(id), c(source), c(text)).alias("h"))
    # with texts, the words are counted twice rather than the texts written once more
    sizes = _shared.written(keyed.drop("row") if with_text else keyed, "sizes")
    targets = _shared.cut(source_targets(sizes, cap, weights))
    few = targets.count() <= MAX_BROADCAST_SOURCES
    sent = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    named = lambda df: df.join(sent(targets.select("s", F.col("source").alias("of"))), F.col("source").eqNullSafe(F.col("of"))).drop("source", "of")
    counts = _shared.cut(named(sizes).where("size > 0").groupBy("s", "size").agg(F.count("*").alias("n")))
    solved = newton_rates(counts, targets, cap).select("s", "n", "source_size", "target", "lam", "mean")
    rated = named(keyed if with_text else sizes).join(sent(solved), "s")
    rate = F.coalesce(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(float(np.log(cap))))), F.lit(1.0))
    bucket = F.pmod("h", F.ceil(F.col("n") / BUCKET_ROWS).cast("long"))
    rated = rated.select("s", bucket.alias("bucket"), "h", "row", "size", "source_size", "target", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rated.drop("s", "bucket", "h").schema] + [T.StructField("copies", T.LongType())])
    done = rated.groupBy("s", "bucket").applyInArrow(_round, schema).withColumn("taken", F.col("copies") * F.col("size"))
    return done.select(*_shared.unpacked(kept), *added)
