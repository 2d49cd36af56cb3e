"""A store of tables in Parquet: immutable snapshots and the rows appended since, and caches keyed by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.operators.lineage import cut


#: appended parts after which a table is written anew as one snapshot
PARTS = 64


class Store:
    """Tables under a path: a snapshot is ``path/table/v=N``, rows appended to what is there are ``path/table/d=N``. Each
    write makes a new version; readers of older ones aren't disturbed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._cache: dict[tuple, DataFrame] = {}

    def _parts(self, table: str) -> list[tuple[int, str]]:
        """(version, kind) of all complete parts, in order."""
        p = self._fs_path(f"{self.path}/{table}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n[:2] in ("v=", "d=") and fs.exists(self._fs_path(f"{self.path}/{table}/{n}/_SUCCESS"))]
        return sorted((int(n[2:]), n[0]) for n in done)

    def versions(self, table: str) -> list[int]:
        return [n for n, _ in self._parts(table)]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The last snapshot up to a version, with what was appended to it."""
        known = [(n, k) for n, k in self._parts(table) if version is None or n <= version]
        if not known:
            return self.spark.createDataFrame([], schemas.ALL[table])
        first = max((i for i, (_, k) in enumerate(known) if k == "v"), default=0)
        paths = [f"{self.path}/{table}/{k}={n}" for n, k in known[first:]]
        out = None
        for path in paths:  # each part has its own columns
            part = self.spark.read.option("basePath", path).parquet(path)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _add(self, table: str, df: DataFrame, kind: str, partition_by: tuple[str, ...] = ()) -> int:
        n = (self.versions(table) or [0])[-1] + 1
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{table}/{kind}={n}")
        self._cache.clear()
        return n

    def write(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """A whole new state of a table. The new version is complete before anyone can see it."""
        return self._add(table, df, "v", partition_by)

    def append(self, table: str, df: DataFrame) -> int:
        """Adds rows without touching what is there; after PARTS of them the table becomes one snapshot again."""
        parts = self._parts(table)
        n = self._add(table, df, "d" if parts else "v")
        tail = 0
        for _, kind in reversed(parts):
            if kind == "v":
                break
            tail += 1
        return n if tail + 1 < PARTS else self.write(table, self.read(table))

    def upsert(self, table: str, df: DataFrame, key: str) -> int:
        """Rows of df replace rows with the same key."""
        return self.write(table, self.read(table).join(df.select(key), key, "left_anti").unionByName(df, allowMissingColumns=True))

    def delete(self, table: str, keys: DataFrame, key: str) -> int:
        return self.write(table, self.read(table).join(keys.select(key), key, "left_anti"))

    def cached(self, name: str, build, *key) -> DataFrame:
        """A derived table, kept until something is written."""
        if (name, *key) not in self._cache:
            self._cache[(name, *key)] = cut(build())
        return self._cache[(name, *key)]

    def statistics(self) -> DataFrame:
        """(table, version, rows) of all tables that have been written."""
        out = None
        for t in schemas.ALL:
            if v := self.versions(t):
                one = self.read(t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), F.lit(v[-1]).alias("version"), "rows")
                out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "table string, version int, rows long")


def by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among keys; of any number of them."""
    return df.join(keys.select(key).distinct(), key, "left_semi")
