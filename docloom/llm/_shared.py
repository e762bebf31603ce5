"""Where jobs keep what every executor must see, how lineage is cut, and how rows travel with columns of any names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.components import reliable as cut
from docloom.operators.components import shared_dir

__all__ = ["column", "cut", "input_partitions", "null_last", "others", "packed", "scratch", "shared_dir", "unpacked", "written"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table or an archive in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder (compressed, columnar; for wide rows)."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_partitions(df: DataFrame) -> int:
    """How many tasks read ``df``; it follows the size of the input and plans no job."""
    return max(1, df.rdd.getNumPartitions())


def column(name: str) -> Column:
    """A column by its exact name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, added: Iterable[str]) -> list[str]:
    """The columns that are returned beside what an operator adds; columns called as what is added are replaced."""
    taken = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in taken]


def packed(names: list[str]) -> Column:
    """These columns as one, so that an operator's own names cannot clash with them."""
    return F.struct(F.lit(0).alias("none"), *[column(c).alias(f"c{i}") for i, c in enumerate(names)])


def unpacked(names: list[str], row: str = "row") -> list[Column]:
    """The packed columns under their own names."""
    return [F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(names)]


def null_last(df: DataFrame, id: str) -> tuple[Column, Callable[[Column], Column]]:
    """A column without nulls in the order of the long ``id``, null as the largest long; and how to get the id back.

    Only where the largest long is an id itself, the ids above one that no row has move down by one.
    """
    none = F.lit((1 << 63) - 1)
    number = column(id).cast("long")
    lowest, highest = df.agg(F.min(number), F.max(number)).first()
    if highest != (1 << 63) - 1:
        return F.coalesce(number, none), lambda c: F.nullif(c, none)
    free = -(1 << 63)
    while lowest == -(1 << 63) and not df.where(number == free).isEmpty():
        free = (free * 6364136223846793005 + 1442695040888963407) % (1 << 64) - (1 << 63)
    moved = F.when(number > free, number - 1).otherwise(number)
    return F.coalesce(moved, none), lambda c: F.when(c != none, F.when(c >= free, c + 1).otherwise(c))
