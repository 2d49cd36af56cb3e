"""Queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; sql is its equivalent for DuckDB."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"epoch_ms\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"(epoch_us(\1) // 1000)", sql)  # epoch_ms rounds
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(c: str | Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    c = F.col(c) if isinstance(c, str) else c
    day = F.unix_date(c.cast("date")).cast("long") * 86_400_000
    return day + F.hour(c).cast("long") * 3_600_000 + F.minute(c).cast("long") * 60_000 + F.floor(F.extract(F.lit("SECOND"), c) * 1000).cast("long")
