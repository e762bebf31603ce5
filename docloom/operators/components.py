"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark deletes the shuffle files of a query when it ends.
GIVE_BACK = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges of a task that are contracted together.
HELD = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where none is set and Spark is local, as in tests, a temporary one of this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """The same rows from the session's checkpoint folder, without the lineage that made them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def _giving_back(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run within delete their shuffle files when they end."""
    before = spark.conf.get(GIVE_BACK, "false")
    spark.conf.set(GIVE_BACK, "true")
    try:
        yield
    finally:
        spark.conf.set(GIVE_BACK, before)


def stored(df: DataFrame) -> DataFrame:
    """As ``reliable``, by a written table, so that plans see its real size.

    A checkpoint keeps the size that Spark estimated for the plan behind it. In a loop of joins that is a
    product that doubles its digits with every round, until planning itself takes all time.

    What was shuffled to make the table is given back at once; else it lies on the executors' disks until the driver
    happens to collect its garbage, and a job of many tables keeps the shuffles of all of them.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _giving_back(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stars(edges: DataFrame) -> DataFrame:
    """A large star and then a small star of edges (hi, lo) with hi > lo, with ``leaf``: whether hi has no other edge.

    Large: what is larger than a node hangs on the smallest of the node and its neighbours. Small: a
    node and what is smaller hang on its smallest neighbour. Only minima meet a node's edges.
    """
    ways = F.array(F.struct(F.col("hi").alias("lo"), F.col("lo").alias("m")), F.struct("lo", F.col("hi").alias("m")))
    least = edges.select(F.inline(ways)).groupBy("lo").agg(F.least(F.min("m"), F.col("lo")).alias("m"))
    large = edges.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    hung = F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    small = large.join(low, "hi").select(F.inline(hung)).where("hi <> lo").distinct()
    ends = F.array(F.struct(F.col("hi").alias("node")), F.struct(F.col("lo").alias("node")))
    single = small.select(F.inline(ends)).groupBy("node").agg((F.count("*") == 1).alias("leaf"))
    return small.join(single.withColumnRenamed("node", "hi"), "hi").select("hi", "lo", "leaf")


def _flat(edges: DataFrame) -> bool:
    """Whether each node of edges (hi, lo) either has one edge to a smaller node or has none to any."""
    ends = F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    with _giving_back(edges.sparkSession):
        return nodes.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (hi, lo) that connect the same nodes as these: each node to the smallest that it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((up := label[label]) != label).any():
            label = up
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as the forests of some that a task has read one after another."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def sent() -> pa.RecordBatch:
        out = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.record_batch([pa.array(x) for x in out], ["u", "v"])

    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        if sum(len(u) for u, _ in held) >= HELD:
            yield sent()
            held.clear()
    if held:
        yield sent()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that is reachable, for every node of ``edges``.

    Large and small stars alternate. After each pair of them a node with a single edge, to a smaller node,
    is set aside with that edge, as it decides nothing for the others; so a hub's edges are worked on
    once or twice, and the rest shrinks with every round until no edge is left. Nodes set aside take the
    labels of their smaller nodes, the last ones first. Null ends and loops are ignored. Raises if
    ``rounds`` do not suffice.

    Before the first round each task contracts the edges that it reads. Where all edges of each component come
    together, like those of short chains, these are the labels, and there are no rounds.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    kinds = dict(pairs.dtypes)
    if kinds["u"] == kinds["v"] and kinds["u"] in ("int", "bigint"):
        pairs = pairs.mapInArrow(_contracted, pairs.schema)
    # read more than once, and what it is made of may be dear
    left = stored(pairs.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    if _flat(left):
        label = left.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        return label.unionByName(label.select(F.col("component").alias("node"), "component").distinct())
    aside: list[DataFrame] = []
    for _ in range(rounds):
        hung = stored(_stars(left))
        aside.append(hung.where("leaf"))
        left = hung.where("NOT leaf").select("hi", "lo")
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    label = aside.pop().select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    while aside:
        up = label.select(F.col("node").alias("lo"), "component")
        down = aside.pop().join(up, "lo", "left").select(F.col("hi").alias("node"), F.coalesce("component", "lo").alias("component"))
        # a label is read twice, so the plan would double with every round
        label = stored(label.unionByName(down))
    return label.unionByName(label.select(F.col("component").alias("node"), "component").distinct())
