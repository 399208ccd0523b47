"""Pandas UDFs declared by DDL at import time, made when first used (the DDL parser needs a session)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator: a function over pandas Series becomes a function over columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, ddl)(*columns)

        call.plain = f
        return call

    return wrap
