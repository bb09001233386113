"""Tables of an index under one folder, through Spark and Hadoop's file systems alone.

Every change writes a new generation of files; a manifest, renamed into place last, names the generations that hold each
list. What a failed change leaves behind is named by no manifest and never read.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.plans.config import need

POSTINGS = "list_no int, offset long, code binary, norm_c smallint, scale_c smallint, err_c smallint, gen int"
RECORDS = "list_no int, offset long, page_no long, id long, payload array<float>, gen int"
#: The directory: where each id is. An id without a row is deleted.
LOCATIONS = "part int, id long, list_no int, offset long, gen int"
TABLES = {"postings": POSTINGS, "records": RECORDS, "locations": LOCATIONS}
#: What a table is divided by, and what it is sorted by within files.
KEYS = {"postings": ("list_no", "offset"), "records": ("list_no", "offset"), "locations": ("part", "id")}
#: Ids in a part of the directory (so there are at most 4,096 parts), and rows of a list in one file at most.
PART, FILE = 1 << 20, 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where that is unset and everything runs in one
    process, a temporary folder is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        need(spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local", "spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="lodevec-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lodevec/{name}-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read_text(self, name: str) -> str | None:
        at = self.path(f"{self.root}/{name}")
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Written beside, then renamed over."""
        part, at = self.path(f"{self.root}/.{name}.part"), self.path(f"{self.root}/{name}")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self.fs.makeQualified(part), self.fs.makeQualified(at), options)

    def write(self, table: str, gen: int, rows: DataFrame) -> None:
        """rows (without gen) as one generation, a directory for each list or part, sorted within files. A long list is
        written by several tasks."""
        at = self.path(f"{self.root}/{table}/gen={gen}")
        self.fs.delete(at, True)  # left by an attempt that failed
        by, order = KEYS[table]
        dealt = rows.repartition(by, F.floor(F.col(order) / FILE)).sortWithinPartitions(by, order)
        dealt.write.partitionBy(by).option("compression", "zstd").parquet(f"{self.root}/{table}/gen={gen}")

    def read(self, table: str, wanted: dict[int, list[int]]) -> DataFrame:
        """Rows of the lists or parts named, each from the generations named: pruned when the plan is made."""
        by_gen: dict[int, list[int]] = {}
        for key, gens in wanted.items():
            for gen in gens:
                by_gen.setdefault(gen, []).append(key)
        if not by_gen:
            return self.spark.createDataFrame([], TABLES[table]).drop("gen")
        held: Column = F.lit(False)
        for gen, numbers in by_gen.items():
            held = held | ((F.col("gen") == gen) & F.col(KEYS[table][0]).isin(sorted(numbers)))
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}").where(held).drop("gen")

    def drop_unused(self, used: set[int]) -> None:
        """Delete generations that nothing is read from."""
        for table in TABLES:
            at = self.path(f"{self.root}/{table}")
            for status in self.fs.listStatus(at) if self.fs.exists(at) else []:
                name = status.getPath().getName()
                if name.startswith("gen=") and int(name[4:]) not in used:
                    self.fs.delete(status.getPath(), True)


def manifest_text(body: dict) -> str:
    return json.dumps(body, sort_keys=True)


def manifest_of(text: str | None) -> dict:
    need(text is not None, "no index here")
    body = json.loads(text)
    need({"version", "generation", "next_id", "lists", "parts", "sizes"} <= set(body) and body["version"] == 2, "not a manifest of this version")
    for name in ("lists", "parts", "sizes"):
        body[name] = {int(k): v for k, v in body[name].items()}
    return body
