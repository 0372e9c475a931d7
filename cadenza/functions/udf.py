"""Arrow functions that are made when they are first used, so that modules can be imported without a session."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(returns: str):
    """Decorator: a function over pandas Series becomes one over columns."""

    def made(function):
        @wraps(function)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(function, returns)(*columns)

        return call

    return made
