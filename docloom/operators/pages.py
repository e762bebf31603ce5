"""Pages of an ordered listing, however deep they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.components import reliable

#: Pages that end before this place are top-k plans, which hold so many rows in each task.
SHALLOW = 10_000

#: A column of the order, and whether it ascends; nulls come first where it does and last where it does not.
Key = tuple[Column, bool]


def _sorted_by(keys: list[Key], names: list[str] | None = None) -> list[Column]:
    cols = [F.col(n) for n in names] if names else [c for c, _ in keys]
    return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, (_, up) in zip(cols, keys, strict=True)]


def _reached(keys: list[Key], place: list, forward: bool) -> Column:
    """Whether a row stands at a place of the order or behind it (in front of it, if not ``forward``)."""
    out = F.lit(True)
    for (c, up), v in reversed(list(zip(keys, place, strict=True))):
        later = up == forward
        if v is None:
            # null is the first of an ascending column and the last of a descending one
            beyond, equal = (c.isNotNull() if forward == up else F.lit(False)), c.isNull()
        else:
            beyond, equal = F.coalesce(c > F.lit(v) if later else c < F.lit(v), F.lit(not later)), c.eqNullSafe(F.lit(v))
        out = beyond | (equal & out)
    return out


def page(rows: DataFrame, keys: list[Key], offset: int, limit: int, shallow: int = SHALLOW) -> DataFrame:
    """The rows ``offset`` to ``offset + limit`` of an order, in order.

    Of a deep page, ranges of the keys alone are counted, which tells the range that holds a place; the keys of the page's first
    and last row are found by sorting that range, and only rows between them are sorted as a whole. What this costs does not depend on ``offset``.
    """
    if offset + limit <= shallow or limit <= 0:
        return rows.orderBy(*_sorted_by(keys)).offset(offset).limit(max(limit, 0))
    names = [f"k{i}" for i in range(len(keys))]
    narrow = rows.select(*[c.alias(n) for n, (c, _) in zip(names, keys, strict=True)])
    # ranges may be drawn anew each time they are planned, so they are kept
    ranged = reliable(narrow.repartitionByRange(*_sorted_by(keys, names)).withColumn("part", F.spark_partition_id()))
    # one row for each range is added up in one place
    counted = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    holding = before.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    by_key = Window.partitionBy("part").orderBy(*_sorted_by(keys, names))
    placed = ranged.join(F.broadcast(holding.drop("n")), "part").withColumn("place", F.col("before") + F.row_number().over(by_key) - 1).withColumn("first", F.col("before") + F.rank().over(by_key) - 1)
    ends = placed.where(F.col("place").between(offset, offset + limit - 1)).agg(F.min_by(F.struct(*names, "first"), "place").alias("lo"), F.max_by(F.struct(*names), "place").alias("hi")).first()
    if ends["lo"] is None:
        return rows.limit(0)
    lo, hi = [ends["lo"][n] for n in names], [ends["hi"][n] for n in names]
    near = rows.where(_reached(keys, lo, True) & _reached(keys, hi, False))
    # rows that equal the first one may stand in front of the page
    return near.orderBy(*_sorted_by(keys)).offset(offset - ends["lo"]["first"]).limit(limit)
