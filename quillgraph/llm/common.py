"""What the operators of this package share: the shared folder, Arrow text buffers, and arrays summed in slices."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from quillgraph.operators.lineage import shared_base


#: folders that this process has written into the shared folder
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    path = f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it again; this cuts its lineage and outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    release()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes what this process has written to the shared folder, once no result that reads it is needed any longer."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in each Arrow batch: whole texts are long, and both sides of a Python worker hold batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now > rows or now <= 0:
        spark.conf.set(name, str(rows))


def put_in_place(fs: pafs.FileSystem, temp: str, name: str) -> None:
    """Gives a whole file its name; one that an earlier attempt of the task left there is the same and makes way."""
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        fs.delete_file(name)
    fs.move(temp, name)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back to the system at its end: workers stay alive for later tasks."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return inner


def release() -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any longer."""
    gc.collect()
    SparkSession.getActiveSession().sparkContext._jvm.System.gc()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without copies; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0]


def pieces(off: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size bytes each; a longer row stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def summed(parts: DataFrame, slices: int, op: str = "add") -> np.ndarray:
    """Adds up (or, with op "or", unites bitwise) arrays that tasks give as rows (slice int, blob binary of int64).

    The array's length is fixed by the caller, so what reaches the driver doesn't grow with the data.
    """

    def add(key, tables):
        total = None
        for blob in tables.column("blob").to_pylist():
            x = np.frombuffer(blob, np.int64)
            total = x if total is None else (total + x if op == "add" else total | x)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([total.tobytes()], pa.binary())})

    rows = parts.groupBy("slice").applyInArrow(add, "slice int, blob binary").collect()
    found = {r["slice"]: np.frombuffer(bytes(r["blob"]), np.int64) for r in rows}
    if not found:
        return np.zeros(0, np.int64)
    each = len(next(iter(found.values())))
    return np.concatenate([found.get(i, np.zeros(each, np.int64)) for i in range(slices)])


def in_slices(total: np.ndarray, slices: int) -> pa.RecordBatch:
    """The rows that summed() takes; slices without a set bit are left out."""
    parts = [(i, x) for i, x in enumerate(np.split(total, slices)) if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], ["slice", "blob"])
