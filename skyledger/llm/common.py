"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the licence and decontamination operators: runs of digits, a-z and non-ASCII characters; and what parts them.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB: a worker holds a batch, its Python copy and its result at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, then hand the memory that its caches held back to the system: Python workers live on through many stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Plain ASCII takes the built-in lower(), which is much faster than translate()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text (null: none) as an array of strings. Splitting is several times faster than extraction."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), BETWEEN_WORDS), lambda w: w != "")


def crc_bucket(id_col: Column, buckets: int) -> Column:
    """crc32 of the id's text, modulo buckets: the fold of a row. A null id has a null fold."""
    return F.crc32(id_col.cast("string").cast("binary")) % buckets


def row_key(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that tell distinct rows apart; rows that repeat share them."""
    tagged = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*tagged).alias("_k1"), F.xxhash64(F.lit("second"), *tagged).alias("_k2")]


def shared_dir(spark: SparkSession, kept: bool = False) -> str:
    """A new folder below the cluster's shared checkpoint folder (spark.checkpoint.dir), which must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/skyledger-checkpoints"  # one machine: driver and executor are one process
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if _scopes and not kept:
        _scopes[-1].append(path)
    return path


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes inside are removed at the end. For callers that have written or collected the result."""
    _scopes.append([])
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def cut(df: DataFrame, *, kept: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start there, even when executors are lost.

    kept: the table outlives the scratch() that it is made in.
    """
    path = shared_dir(df.sparkSession, kept)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does when the driver forgets them, which its garbage
    collector finds out. For operators whose later steps need the room."""
    gc.collect()
    spark._jvm.System.gc()


def slices(n: int, step: int) -> Iterator[slice]:
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))
