"""What the operators of this subpackage share: table reading, shared storage, chunking of Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python operator holds in decoded form at once.
CHUNK_BYTES = 2 << 20

#: Bytes that Spark hands to Python at once, about: a batch is held whole, and texts may be long.
BATCH_BYTES = 2 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, a local session gets a temporary one, removed when it ends; on a cluster, RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rasterbrook-"))
        current = spark.sparkContext.getCheckpointDir()
        remove(spark, current, at_exit=True)
    return current


def remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder in any store that Spark writes to, now or when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.deleteOnExit(at) if at_exit else store.delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, its lineage cut; lost executors don't bring back what lies before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(source: int, doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo source; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(source))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def utf8(text: Column | str) -> Column:
    """A text column as Python workers can read it: each invalid UTF-8 sequence is U+FFFD."""
    return F.make_valid_utf8((F.col(text) if isinstance(text, str) else text).cast("string"))


def release() -> None:
    """Gives freed memory back, which a worker that is kept would hold otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _bytes(size: str) -> int:
    """A size as Spark writes it, like 64m or 67108864b."""
    units = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40}
    size = size.lower()
    if len(size) > 2 and size[-1] == "b" and size[-2] in units:
        size = size[:-1]
    return int(size[:-1]) << units[size[-1]] if size[-1] in units else int(size)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in batches of at most about BATCH_BYTES, a setting of the session that is lowered if need be; memory is given back at a partition's end."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(conf.get(name)) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with at most about limit bytes of text each (one longer text stands alone), and those texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            n = 0 if n != n else int(n)
            if i > start and held + n > limit:
                yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start), column.slice(start).to_pylist()
