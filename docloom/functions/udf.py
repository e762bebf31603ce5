"""Vectorised helpers that are made when they are first used, so that modules can be imported without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def batch_helper(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like pandas_udf with a type in DDL, made at the first call."""

    def mark(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(fn, returns)(*columns)

        return call

    return mark
