"""Shared helpers: materialised intermediates in the cluster's shared folder, Arrow views of texts."""

from __future__ import annotations

import atexit
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints/trawl"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``; only a single-machine session without that setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + LOCAL_CHECKPOINTS


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the cluster's own clean-up takes the folder
        pass


def materialise(df: DataFrame, name: str, block: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    block: bytes of a row group, which a task holds while it writes; Parquet's own size if not given.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.option("parquet.block.size", block) if block else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(doc_id: Column, sha: Column) -> Column:
    """One key of a row's id, which may be null or repeated, and its text's digest."""
    return F.concat_ws("/", sha, F.coalesce(doc_id.cast("string"), F.lit("")))


def byte_view(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """(all bytes, n + 1 offsets into them) of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return b"", np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None else b""
    return whole, offsets - offsets[0]


def crc_remainder(ids: list, parts: int = 3) -> np.ndarray:
    """crc32(id as text) mod parts; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % parts for i in ids], np.int64)


def crc_remainder_column(column: str, parts: int = 3) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def hash_sample(df: DataFrame, key: str, most: int, total: int, seed: int) -> DataFrame:
    """At most ``most`` rows of df, those with the smallest hashes of key; ``total`` is df's number of rows.

    Only about twice as many rows as are wanted pass the filter, so neither the tasks nor the driver gather more
    however many tasks there are.
    """
    uniform = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 31)) / float(1 << 31)
    if total > 2 * most:
        df = df.filter(uniform < 2 * most / total)
    return df.orderBy(uniform, key).limit(most)
