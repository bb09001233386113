"""What the operators of this subpackage share: the shared folder, written tables, byte-level text access."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.sources.store import shared_path

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Codec of intermediate tables. Not lz4_raw: reads of its pages failed on whole tables ("all input must be consumed").
CODEC = "zstd"
#: Bytes of text that the numpy code looks at in one go.
CHUNK_BYTES = 1 << 20
#: 64-bit constants of the mixing function (golden ratio and two odd numbers from its fractional powers).
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def written(df: DataFrame, name: str, paths: list[str] | None = None, partition_by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again, which cuts its lineage. paths gets the folder's path."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    out = df.write.option("compression", CODEC)
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    paths.clear()


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def boxed(docs: DataFrame, **named: Column) -> DataFrame:
    """docs with all columns in one struct, _row, and further columns: no name of docs can clash with ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(c.alias(n) for n, c in named.items()))


def words_column(column: Column) -> Column:
    """Number of words of a text, null: 0."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows, those with the smallest hashed keys, so the choice doesn't depend on partitions.

    Rows are first thinned by their hash to about twice that number in all, so what meets in one task to be ranked
    doesn't grow with the table or with its number of partitions.
    """
    n = rows.count()
    spread = F.pmod(F.xxhash64(F.col(key), F.lit(23)), F.lit(1 << 30))
    thin = rows.where(spread < int(min(1.0, 2 * most / max(n, 1)) * (1 << 30))) if n > 2 * most else rows
    return thin.orderBy(spread, key).limit(most)


def tidy(run):
    """run, for mapInArrow; what a task freed goes back to the system when it ends, as its worker then waits idle while
    other stages need the memory."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX_B
    x ^= x >> np.uint64(29)
    x *= MIX_A
    x ^= x >> np.uint64(32)
    return x


def buffers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of a binary column as (first row, bytes, offsets into them), about CHUNK_BYTES each; a longer row comes alone and whole."""
    if not len(column):
        return
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        own = offsets[first : last + 1]
        yield first, data[own[0] : own[-1]], own - own[0]
        first = last


def gram_codes(data: np.ndarray, order: int, bits: int, seed: int) -> np.ndarray:
    """Hashed byte n-grams, one for each start position, as numbers of so many bits."""
    n = max(0, len(data) - order + 1)
    code = data[:n].astype(np.uint32)
    for k in range(1, order):
        code = code * np.uint32(257) + data[k : k + n]
    code = (code ^ np.uint32(seed * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0xC2B2AE35)
    return code >> np.uint32(32 - bits)


def sums_by_row(values: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each row the sum of the values at the n-gram starts that lie inside it."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.clip(offsets[1:] - order + 1, offsets[:-1], None)
    return total[np.minimum(ends, len(values))] - total[np.minimum(offsets[:-1], len(values))]
