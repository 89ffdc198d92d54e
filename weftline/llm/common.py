"""What the operators of this subpackage share.

Rows reach Python only as Arrow batches (``mapInArrow``).  Spark bounds a batch by
bytes (``spark.sql.execution.arrow.maxBytesPerBatch``); within a task it is worked
off in slices of ``BATCH_ROWS`` rows.  No setting of the caller's session is changed.
Intermediate tables go to the folder named by ``spark.checkpoint.dir``; ``discard``
deletes those that no later step reads.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS = 512
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    Only a local master may do without: there driver and executors are one process, and a
    temporary folder is set.  Anywhere else executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written``; only for those that nothing still to be run reads."""
    for t in tables:
        remove_path(t.sparkSession, t._stored_at)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Gives what a worker has freed back to the system: workers outlive their tasks and would keep the room of their largest slice."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc's own
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose workers keep no freed memory between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Applies ``fn`` to slices of at most ``BATCH_ROWS`` rows of each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(fn, slices(batches))

    return map_batches(df, run, schema)


def join_counted(big: DataFrame, small: DataFrame, key: str, rows: str, least: int = 256, parts: int = 4096) -> DataFrame:
    """Inner join of ``big`` with the stored table ``small``, which has one row a key and in ``rows`` how many rows of ``big`` hold the key.

    Keys with more than a ``parts``-th of all rows (so at most ``parts`` keys, whatever the data) are broadcast, so that
    none of them goes to one task; the others are shuffled.  Where no key is so common it is a plain join.
    """
    total, most = small.agg(F.sum(rows), F.max(rows)).first()
    limit = max(least, (total or 0) // parts)
    if (most or 0) <= limit:
        return big.join(small, key)
    hot = F.col(rows) > limit
    common = small.filter(hot)
    return big.join(F.broadcast(common), key).unionByName(big.join(F.broadcast(common.select(key)), key, "left_anti").join(small.filter(~hot), key))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a string column, nulls as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class WordHash(dict):
    """64-bit hash of a word, remembered; forgets everything past ``limit`` words."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that polynomial hashes become uniform."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive entries of ``h``."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix64(out)
