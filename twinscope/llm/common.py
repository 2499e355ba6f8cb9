"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer text is a pass of its own, or several (see lexical.segments).
CHUNK_BYTES = 1 << 18
#: Rows that Spark hands to Python at once, unless the session says otherwise.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, read by Spark so that any store works.

    A session with Spark's default of 10 000 rows a batch is set to ARROW_ROWS, since a batch of whole texts is
    held several times over, by the executor and by its Python worker.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is `spark.checkpoint.dir`. Only a session with a local master may leave that unset
    (tests do); it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(spark, "_twinscope_shared", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="twinscope-")
            spark._twinscope_shared = root
    if "://" in root:
        return root
    return "file://" + root.removeprefix("file:")


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared one, as a URI."""
    path = f"{shared_dir(spark).rstrip('/')}/twinscope/{what}-{uuid.uuid4().hex}"
    fs, local = open_fs(path)
    fs.create_dir(local, recursive=True)
    return path


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.parquet(path + "/table")
    out = spark.read.schema(df.schema).parquet(path + "/table")
    out._twinscope_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables; for those that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_twinscope_path", None)
        if path:
            fs, local = open_fs(path)
            fs.delete_dir(local)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where the remainder matches; a null id is never held out."""
    return F.coalesce(crc_mod(doc_id, modulus) == remainder, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive runs of rows of about `limit` bytes: (first row, end row, bytes, offsets from 0)."""
    if len(column) == 0:
        return
    raw, offs = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
