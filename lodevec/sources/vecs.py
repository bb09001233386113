"""Files of vectors: rows of a 32-bit dimension and that many 32-bit floats (fvecs), bytes (bvecs) or integers (ivecs).

A Spark data source: spark.dataSource.register(VecsSource), then spark.read.format("vecs").load(path). Rows have one
length, so a file is cut into row ranges that tasks read on their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodevec.plans.config import need

#: Number type and Spark type of each kind of file.
KINDS = {"fvecs": ("<f4", "float"), "bvecs": ("u1", "smallint"), "ivecs": ("<i4", "int")}


class Rows(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class VecsReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.kind, self.per = path, path.rsplit(".", 1)[-1], rows

    def open(self):
        store, at = fs.FileSystem.from_uri(self.path)
        return store.open_input_file(at)

    def shape(self) -> tuple[int, int, int]:
        """(rows, dimension, bytes of a row)."""
        with self.open() as file:
            size = file.size()
            if size == 0:
                return 0, 0, 0
            need(size >= 4, "the file ends inside a row")
            d = int(np.frombuffer(file.read(4), "<i4")[0])
        need(d > 0, "a dimension must be positive")
        width = 4 + d * np.dtype(KINDS[self.kind][0]).itemsize
        need(size % width == 0, "the file ends inside a row, or rows differ in dimension")
        return size // width, d, width

    def partitions(self) -> list[InputPartition]:
        n = self.shape()[0]
        return [Rows(at, min(self.per, n - at)) for at in range(0, n, self.per)] or [Rows(0, 0)]

    def read(self, partition: Rows):
        if not partition.count:
            return
        _, d, width = self.shape()
        number = np.dtype(KINDS[self.kind][0])
        with self.open() as file:
            file.seek(partition.first * width)
            raw = np.frombuffer(file.read(partition.count * width), np.uint8).reshape(-1, width)
        need(bool((raw[:, :4].copy().view("<i4") == d).all()), "rows differ in dimension")
        values = raw[:, 4:].copy().view(number)
        if self.kind == "bvecs":
            values = values.astype(np.int16)
        flat = pa.array(values.reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.first + len(raw))), lists], ["row_id", "embedding"])


class VecsSource(DataSource):
    """Options: path; rows, the rows that a task reads (100,000)."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def kind(self) -> str:
        kind = self.options["path"].rsplit(".", 1)[-1]
        need(kind in KINDS, "a vector file ends in .fvecs, .bvecs or .ivecs")
        return kind

    def schema(self) -> str:
        return f"row_id long, embedding array<{KINDS[self.kind()][1]}>"

    def reader(self, schema) -> DataSourceReader:
        self.kind()
        return VecsReader(self.options["path"], int(self.options.get("rows", 100_000)))


def read_vectors(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """(row_id, embedding) of a file, by its ending."""
    spark.dataSource.register(VecsSource)
    return spark.read.format("vecs").option("rows", str(rows)).load(path)


def read_neighbours(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(qid, rank, id): the first k ids of each row of an ivecs file; shorter rows and negative ids fail."""
    rows = read_vectors(spark, path)
    ids = F.slice("embedding", 1, k)
    good = (F.size("embedding") >= k) & F.forall(ids, lambda x: x >= 0)
    checked = F.when(good, ids).otherwise(F.raise_error(F.lit("a row has too few ids, or a negative one")).cast("array<int>"))
    return rows.select(F.col("row_id").alias("qid"), F.posexplode(checked).alias("rank", "id")).select("qid", (F.col("rank") + 1).alias("rank"), F.col("id").cast("long").alias("id"))


def validate_dataset(learn: DataFrame, base: DataFrame, queries: DataFrame, truth: DataFrame, dimension: int, least_learn: int = 1024, k: int = 10) -> None:
    """ValueErrors for what an evaluation can't use."""
    for name, frame in (("learn", learn), ("base", base), ("queries", queries)):
        need(frame.where(F.size("embedding") != dimension).isEmpty(), f"{name}: a vector hasn't {dimension} numbers")
    n, asked = base.count(), queries.count()
    need(learn.count() >= least_learn, "too few rows to learn from")
    need(n >= k and asked > 0, "too few rows or no queries")
    need(truth.agg(F.count_distinct("qid")).first()[0] >= asked, "fewer rows of ground truth than queries")
    need(truth.where(F.col("id") >= n).isEmpty(), "ground truth names a row that isn't there")
