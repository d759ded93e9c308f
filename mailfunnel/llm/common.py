"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine, as in tests) gets a temporary one that goes with the process; on a
    cluster that is an error, since executors would write where no other reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    path, spark, schema = new_path(df.sparkSession, name), df.sparkSession, df.schema
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of steps that are over
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` as a table bucketed by ``key`` in the shared folder: later joins on the key don't shuffle it. Best dealt out by ``repartition(partitions, key)`` before."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = os.path.basename(path).replace("-", "_")
    df.write.bucketBy(partitions(spark), key).option("path", path).format("parquet").saveAsTable(table)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.table(table)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a ``staged`` table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``. Texts go to Python workers in batches of at most 8 MB from then on (a setting of the session)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str):
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id, modulus: int) -> int:
    """crc32 of the id as text, modulo: the rule that splits labelled rows into folds."""
    return zlib.crc32(str(doc_id).encode()) % modulus


def steps(lengths: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs ``(low, high)`` of rows whose lengths add up to at most ``most``, one row at least: bounds what a task holds at once."""
    low = total = 0
    for i, n in enumerate(lengths):
        if i > low and total + n > most:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(lengths):
        yield low, len(lengths)


_kept: dict = {}


def kept(key: Hashable, make: Callable):
    """What ``make`` gives, remembered in this Python worker for later tasks. Only the last key's is kept: a worker serves all stages."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            given_back()
        _kept[key] = make()
    return _kept[key]


def given_back() -> None:
    """Gives memory that this worker has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """``run`` over an iterator, with memory that the task freed given back at its end."""

    def of(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            given_back()

    return of


def original(text: str, low: str) -> Callable[[int, int], tuple[int, int]]:
    """Turns a span of ``low``, the lower-cased text, into one of the text: a few letters grow when lower-cased."""
    if len(text) == len(low):
        return lambda start, end: (start, end)
    at = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
    return lambda start, end: (int(at[start]), int(at[end - 1]) + 1)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))
