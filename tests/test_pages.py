"""Deep pages against slices of the sorted rows."""

import random

from pyspark.sql import functions as F

from docloom.operators.pages import page


def test_pages_equal_slices(spark):
    """Ties, nulls, both directions, pages across ranges, past the end and of no rows."""
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(6)]), rng.choice([None, "a", "b", "c"]), i % 90) for i in range(400)]
    df = spark.createDataFrame(rows, "x int, y string, id long").repartition(5)
    for ups in ((True, False, True), (False, True, False)):
        keys = list(zip([F.col("x"), F.col("y"), F.col("id")], ups, strict=True))
        place = lambda r: tuple((v is not None, v) if up else (v is None, -v if isinstance(v, int) else [-ord(c) for c in v or ""]) for v, up in zip(r, ups, strict=True))  # noqa: E731, B023
        order = sorted(rows, key=lambda r: [tuple(p if p is not None else 0 for p in q) if isinstance(q[1], (int, type(None))) else q for q in place(r)])
        for offset, limit in ((0, 7), (57, 40), (399, 5), (400, 5), (120, 200), (10, 0)):
            got = [tuple(r) for r in page(df, keys, offset, limit, shallow=0).collect()]
            assert got == order[offset : offset + limit], (ups, offset, limit)
            assert got == [tuple(r) for r in page(df, keys, offset, limit).collect()]
    assert page(df.limit(0), keys, 50, 5, shallow=0).count() == 0
