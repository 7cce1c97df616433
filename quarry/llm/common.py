"""Shared helpers: tables in the cluster's shared folder and Arrow plumbing."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset, a folder of our own is made and set, but
    only if driver and executors are one process: a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str, over: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage like a checkpoint, but as columnar files: a lost executor
    costs a re-read, never a recomputation of the corpus pass behind it.
    ``over`` is a table written before that nothing needs from now on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    found = spark.read.schema(schema).parquet(path)
    _PATHS[found] = path
    if over is not None:
        done_with(over)
    return found


def done_with(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` has written and nothing needs any more."""
    for table in tables:
        if (old := (table.sparkSession, _PATHS.pop(table))) in _WRITTEN:
            _WRITTEN.remove(old)
            discard(*old)


def let_go(spark: SparkSession) -> None:
    """Have the driver notice which plans are gone, so that the shuffle files behind them are deleted."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(but: frozenset[str] = frozenset()) -> None:
    """Delete the tables that :func:`materialize` has written, but for the paths named."""
    gone, _WRITTEN[:] = [x for x in _WRITTEN if x[1] not in but], [x for x in _WRITTEN if x[1] in but]
    for spark, path in gone:
        if spark.sparkContext._jsc is not None:  # a session that is gone takes its folder with it
            discard(spark, path)


def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001 - the process ends anyway
        pass


atexit.register(_release_at_exit)


@contextmanager
def passing() -> Iterator[None]:
    """Tables written inside are deleted at the end, but for the last one: the result."""
    had = {path for _, path in _WRITTEN}
    yield
    release(frozenset(path for _, path in _WRITTEN if path in had) | {path for _, path in _WRITTEN[-1:]})


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes in a column of texts; a longer text stands alone.

    Spark bounds a batch's bytes itself (``spark.sql.execution.arrow.maxBytesPerBatch``);
    this bounds what an operator makes of one at a time.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def gather(batches) -> pa.Table | None:
    """A partition's batches as one table; None if it has no row."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()
