"""Arrow UDFs that can be declared before there is a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like pandas_udf with a type in words; the UDF is made when it is first used on columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def on_columns(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return on_columns

    return wrap
