"""Table access and intermediate storage used by the operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
#: Java regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (tests, one machine) an own one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="palisade-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return "file://" + _own_folder[0]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs one task of a later step
    and never a replay of the earlier ones.  Files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palisade-{tag}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palisade_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a materialized table that no later step reads."""
    path = getattr(df, "_palisade_path", None)
    if path:
        _forget(df.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the JVM may be gone already at exit
        pass


#: Bytes of rows that cross to a Python worker at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python workers are cut by bytes, so that long texts need no more memory than short ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def tidy(run: Callable[[Iterator], Iterator], after: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """run, at whose end the worker gives back what it has freed: the same process serves later tasks, of other operators too."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            if after:
                after()
            trim()

    return whole


def trim() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, modulus: int):
    """crc32 of the value as text, modulo modulus; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8 - int(np.argmax(planes[::-1].any(1))) if len(values) and planes.any() else 1
    return bytes([used]) + b"".join(len(c).to_bytes(4, "little") + c for c in (zstandard.compress(planes[i].tobytes(), 1) for i in range(used)))


def unsqueeze(raw: bytes) -> np.ndarray:
    used, at, planes = raw[0], 1, []
    for _ in range(used):
        n = int.from_bytes(raw[at : at + 4], "little")
        planes.append(np.frombuffer(zstandard.decompress(raw[at + 4 : at + 4 + n]), np.uint8))
        at += 4 + n
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for i, p in enumerate(planes):
        out[:, i] = p
    return out.view(np.uint64).ravel()
