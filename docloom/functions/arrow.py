"""Arrow-batched functions whose result type is parsed when they are first used."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(result: str) -> Callable:
    """Turn a function of pandas Series into a function of Columns."""

    def lift(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(f, result)(*columns)

        del call.__wrapped__
        return call

    return lift
