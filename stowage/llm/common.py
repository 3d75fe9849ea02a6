"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import ensure_checkpoint_dir

#: A word: a run of anything but ASCII blanks (same text in Java, Python and DuckDB regular expressions).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch handed to a Python worker, so that long texts don't pile up in its memory.
BATCH_BYTES = 8 << 20


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and go on from the copy.

    The copy cuts the lineage, survives lost executors, freezes row numbers given
    by ``monotonically_increasing_id`` and carries its measured size, from which
    Spark decides about broadcasts.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def drop_table(table: DataFrame) -> None:
    """Remove a stage table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """The shuffle files of a query that runs inside go when it ends, not when the driver's JVM next collects garbage.

    For queries that run once, such as those that write stage tables.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows that Spark's Parquet reader holds at a time; its 4,096 are too many for rows of long texts or packed arrays.
READ_ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Bound this session's batches by BATCH_BYTES and READ_ROWS, so that long values don't pile up in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_seq() -> Column:
    """A number for each row; stable once written by :func:`stage_table`."""
    return F.monotonically_increasing_id()


def crc_rest(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def byte_texts(texts) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; a null text is empty."""
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def groups_by_bytes(texts: list[bytes], most: int):
    """Consecutive (first, last) ranges of ``texts`` of about ``most`` bytes each, one text at least."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield first, k
            first, held = k, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


_MULT = np.uint32(0x01000193)


def ngram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of the n bytes that start at each position (the last n - 1 positions have none)."""
    h = np.full(max(len(data) - n + 1, 0), 0x811C9DC5 + n, dtype=np.uint32)
    for k in range(n):
        h ^= data[k:k + len(h)]
        h *= _MULT
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


#: Bytes of texts that are hashed at a time.
PIECE = 1 << 19


def hashed_counts(texts: list[bytes], orders: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts of hashed byte n-grams, one row of ``dims`` (a power of two) per text, over whole texts."""
    out = np.zeros((len(texts), dims), dtype=np.float32)
    over = max(orders) - 1
    for first, last in groups_by_bytes(texts, PIECE):
        if last - first == 1 and len(texts[first]) > PIECE:  # a long text, in slices that overlap by n - 1 bytes
            whole = np.frombuffer(texts[first], dtype=np.uint8)
            for at in range(0, len(whole), PIECE):
                for n in orders:
                    h = ngram_hashes(whole[at:at + PIECE + n - 1], n)
                    out[first] += np.bincount(h & np.uint32(dims - 1), minlength=dims)
            continue
        lens = np.array([len(t) for t in texts[first:last]], dtype=np.int64)
        data = np.frombuffer(b"".join(texts[first:last]) + b"\0" * over, dtype=np.uint8)
        left = np.repeat(np.cumsum(lens), lens) - np.arange(lens.sum())  # bytes from here to the text's end
        base = np.repeat(np.arange(last - first) * dims, lens)
        total = np.zeros((last - first) * dims, dtype=np.int64)
        for n in orders:
            h = ngram_hashes(data, n)[: len(left)]
            at = base + (h & np.uint32(dims - 1))
            total += np.bincount(at[left >= n] if n > 1 else at, minlength=len(total))
        out[first:last] += total.reshape(last - first, dims)
    return out
