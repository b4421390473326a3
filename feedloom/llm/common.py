"""What the operators of this subpackage share: shared-folder paths, word rules, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_RESIDENT: list = [None, None]


def resident(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: the last one asked for. Workers outlive a stage, so keeping each
    operator's models and caches would add up."""
    if _RESIDENT[0] != key:
        let_go()
        _RESIDENT[:] = [key, make()]
    return _RESIDENT[1]


def trimmed() -> None:
    """Gives the system back what the allocators keep of freed memory: Python's objects, Arrow's buffers and NumPy's
    arrays each have one of their own, and what one keeps no other can use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # not every C library has it
        pass


def let_go() -> None:
    """Drops what another operator keeps in this Python worker. An executor's memory is that of its JVM, whose heap fills
    in time, and of all its workers, so operators that keep nothing call this as each of their tasks or groups begins."""
    if _RESIDENT[0] is not None:
        _RESIDENT[:] = [None, None]
        gc.collect()
    trimmed()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all run in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="feedloom-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses. What is written there stays, since a result may be read again
    as long as its DataFrame lives; a job that is done may delete the folder."""
    return f"{shared_dir(spark)}/feedloom/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for small rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ascii_lower(data: bytes) -> bytes:
    """Lower-cases A-Z only; other bytes of UTF-8 stay."""
    return data.lower()


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of text; one longer text makes a batch of its own. Memory that is
    free again after each goes back to the system."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array([x or 0 for x in pc.binary_length(column).to_pylist()], dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            trimmed()
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
