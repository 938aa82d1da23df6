"""Helpers that the corpus operators share: scratch tables, hashing, batch iteration."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words (fixed by the contracts): space and the bytes 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"

_made: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which a cluster names.

    Where it is unset, a local master gets a temporary folder of its own. On a cluster the
    warehouse serves, unless that is a folder of one machine, which executors do not share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return f"file://{tempfile.gettempdir()}/marlstone-{os.getuid()}"
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return warehouse.rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/marlstone-{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, wherever it lives."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


@contextlib.contextmanager
def scratch_until_end(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the scratch paths made inside it; what is still to be read must lie elsewhere."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            remove(spark, path)


def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and gives the optimiser
    true sizes to choose its joins by.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[str, object] = {}


def resident(key: str, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: one object, that of the key last asked for.

    Tasks of one stage share it. Another stage's key takes its place, and the memory of the former
    goes back to the system first, so a process holds what one stage needs, not the sum of all
    stages that it ever served.
    """
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
        give_back()
    return _kept[key]


def give_back() -> None:
    """Return what this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def fresh(name: str) -> str:
    """A column name that clashes with none that a table brings."""
    return f"{name}_{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result (uint64, wrapping)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice's column holds at most most_bytes, or one row."""
    for b in batches:
        values = b.column(b.schema.get_field_index(column))
        if b.num_rows == 0:
            continue
        sizes = np.diff(np.frombuffer(values.buffers()[1], dtype=np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64))
        total = np.cumsum(sizes)
        start = 0
        while start < b.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
            yield b.slice(start, end - start)
            start = end


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a text column without decoding it; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def small_enough(df: DataFrame, size: Column, most_bytes: int) -> bool:
    """Whether the sum of size over df stays within most_bytes; measured, before a broadcast."""
    total = df.agg(F.sum(size).alias("n")).first()["n"]
    return (total or 0) <= most_bytes


def maybe_broadcast(df: DataFrame, size: Column, most_bytes: int = 32 << 20) -> DataFrame:
    """df marked for broadcast if its measured size allows it; else as it is, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, size, most_bytes) else df


def join_counted(left: DataFrame, right: DataFrame, on: str, count: str, rows: int, hot: int = 1_000_000) -> DataFrame:
    """left joined to right, whose rows are unique by `on` and say in `count` how often it stands in left, which has `rows` rows.

    Keys that stand `hot` times or more are joined by broadcast, so none of them meets in one task;
    there are at most rows / hot of them. With fewer rows than that no key can be hot.
    """
    if rows < hot:
        return left.join(right, on)
    left, right = materialise(left, "left"), materialise(right, "right")
    heavy = F.broadcast(right.where(F.col(count) >= hot))
    rest = left.join(heavy.select(on), on, "left_anti").join(right.where(F.col(count) < hot), on)
    return rest.unionByName(left.join(heavy, on))


def left_join_counted(left: DataFrame, right: DataFrame, on: str, count: str, size: Column, hot: int = 1_000_000, most_bytes: int = 32 << 20) -> DataFrame:
    """All rows of left, with right's columns where `on` is in it; right's rows are unique by `on`, and `count` says how often left has it.

    right is broadcast if its measured size allows it. Beyond that only the keys that stand `hot`
    times or more are, at most rows / hot of them; rows without key are joined to nothing.
    """
    if small_enough(right, size, most_bytes):
        return left.join(F.broadcast(right), on, "left")
    right = materialise(right, "right")
    heavy = F.broadcast(right.where(F.col(count) >= hot))
    rest = left.where(F.col(on).isNotNull()).join(heavy.select(on), on, "left_anti").join(right.where(F.col(count) < hot), on, "left")
    return rest.unionByName(left.join(heavy, on)).unionByName(left.where(F.col(on).isNull()), allowMissingColumns=True)
