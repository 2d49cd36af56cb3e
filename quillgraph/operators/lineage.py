"""Cutting lineage: iterations and shared intermediate tables are written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, as a URI; a path without a scheme is one of Hadoop's default file system.

    Only on a single machine without that setting a folder of our own under /tmp is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and found.isDefined():
        base = found.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/quillgraph-shared"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from then on."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), for wide tables of which readers take some columns only: as Parquet, not as serialised rows."""
    path = f"{shared_base(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
