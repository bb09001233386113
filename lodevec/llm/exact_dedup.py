"""Exact dedup: a log-structured merge index of text digests.

Memtables (slices of the input, aggregated in memory with map-side combine) flush sorted runs of (digest, identifier,
rows) as Parquet, each with a filter of its digests. Compaction probes the filters: a digest that no other run's filter
has is merged already, and its row moves no more; the others are merged, keeping one identifier for each digest and the
sum of its rows. Digests with several rows are hits, and the index says which identifier stays and how many there are.
A filter over the hits spares all other documents any shuffle. Hits receive byte verification: documents that pass are
grouped by digest and text, and where a digest stands for several texts, each text gets an answer of its own.

Filters are sized from the number of their digests, up to a bound; beyond it they let more pass, and nothing else changes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import CODEC, boxed, drop_paths, written
from lodevec.sources.store import shared_path

#: Bits in one row of a filter (what bitmap_construct_agg makes), as an exponent and a number.
BITMAP_LOG, BITMAP = 15, 32_768
RUN = "digest binary, id long, n long, run int"


@dataclass(frozen=True)
class DedupParams:
    """keep: which identifier of equal texts stays, 'largest' or 'smallest'; memtables: runs flushed for one batch;
    most_bits: a filter has at most 2**most_bits bits (30: 128 MB, so it can be broadcast at any input size);
    digest_bytes: bytes of SHA-256 in the index (fewer are for tests of the byte check)."""

    keep: str = "largest"
    memtables: int = 4
    most_bits: int = 30
    digest_bytes: int = 32


def digest_of(text: Column, params: DedupParams) -> Column:
    full = F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    return full if params.digest_bytes == 32 else F.substring(full, 1, params.digest_bytes)


def filter_bits(count: int, most: int = 30, each: int = 16) -> int:
    """Bits of a filter for so many digests, as an exponent: about each of them a digest, so a sixteenth of others pass."""
    return max(BITMAP_LOG, min(most, math.ceil(math.log2(max(count, 1) * each))))


def slot(digest: Column, bits: int) -> Column:
    """The filter's bit for a digest: taken from a second hash, so short digests spread as well."""
    return F.shiftrightunsigned(F.xxhash64(digest), 64 - bits)


def hit_filter(hits: DataFrame, bits: int, *by: str) -> DataFrame:
    """(by, _part, _bits): at most 2**bits / BITMAP rows of 4 KB for each of the values of by."""
    at = slot(F.col("digest"), bits)
    return hits.select(*by, F.shiftright(at, BITMAP_LOG).alias("_part"), at.bitwiseAND(BITMAP - 1).alias("at")).groupBy(*by, "_part").agg(F.expr("bitmap_construct_agg(at)").alias("_bits"))


def bit_set(bits: str, at: str) -> str:
    """SQL: whether a bitmap has a bit."""
    byte = f"cast(conv(hex(substring({bits}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    return f"(shiftright({byte}, cast({at} % 8 as int)) & 1) = 1"


def with_mark(docs: DataFrame, digest: str, filter_rows: DataFrame, bits: int) -> DataFrame:
    """docs with _maybe: whether the filter has the row's digest. The filter's size is bounded, so it is broadcast."""
    at = slot(F.col(digest), bits)
    joined = docs.withColumn("_slot", at.bitwiseAND(BITMAP - 1)).withColumn("_at", F.shiftright(at, BITMAP_LOG)).join(F.broadcast(filter_rows), F.col("_at") == F.col("_part"), "left")
    return joined.withColumn("_maybe", F.expr(f"coalesce({bit_set('_bits', '_slot')}, false)")).drop("_at", "_part", "_bits", "_slot")


class DigestIndex:
    """Runs under one folder: run=<k> directories, each sorted by digest within its files, and a table of their filters."""

    def __init__(self, spark: SparkSession, path: str, params: DedupParams = DedupParams()):
        self.spark, self.path, self.params, self.runs, self.rows = spark, path, params, [], 0

    def best(self, column: str) -> Column:
        return F.max(column) if self.params.keep == "largest" else F.min(column)

    def table(self) -> DataFrame:
        """(digest, id, n, run) of all runs."""
        return self.spark.read.schema(RUN).parquet(self.path)

    def flush(self, docs: DataFrame) -> None:
        """Add a batch (doc_id, text): each memtable becomes a run of (digest, id, n)."""
        p, first = self.params, len(self.runs)
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), digest_of(F.col("text"), p).alias("digest"))
        table = rows.withColumn("run", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(p.memtables)).cast("int") + first).groupBy("run", "digest").agg(self.best("id").alias("id"), F.count(F.lit(1)).alias("n"))
        table.sortWithinPartitions("run", "digest").write.mode("append").partitionBy("run").option("compression", CODEC).parquet(self.path)
        self.runs += range(first, first + p.memtables)

    def probed(self, paths: list[str]) -> DataFrame:
        """(digest, id, n, _again) of all runs; _again: whether another run's filter has the digest. All filters
        together are within the bound."""
        share = int(math.log2(max(len(self.runs), 1)))
        bits = filter_bits(self.table().count() // max(len(self.runs), 1), self.params.most_bits - share - 1, 8)
        filters = written(hit_filter(self.table().select("run", "digest"), bits, "run"), "filters", paths)
        by_part = filters.groupBy("_part").agg(F.collect_list(F.struct("run", "_bits")).alias("_runs"))
        at = slot(F.col("digest"), bits)
        rows = self.table().withColumn("_slot", at.bitwiseAND(BITMAP - 1)).withColumn("_at", F.shiftright(at, BITMAP_LOG)).join(F.broadcast(by_part), F.col("_at") == F.col("_part"), "left")
        return rows.withColumn("_again", F.expr(f"coalesce(exists(_runs, x -> x.run <> run and {bit_set('x._bits', '_slot')}), false)")).select("digest", "id", "n", "_again")

    def compact(self) -> None:
        """Replace the runs by one that holds what they hold."""
        paths: list[str] = []
        rows = self.probed(paths)
        merged = rows.where("_again").groupBy("digest").agg(self.best("id").alias("id"), F.sum("n").alias("n"))
        path = shared_path(self.spark, "compacted")
        one = rows.where("not _again").drop("_again").unionByName(merged).sortWithinPartitions("digest").withColumn("run", F.lit(0))
        one.write.partitionBy("run").option("compression", CODEC).parquet(path)
        drop_paths(self.spark, [*paths, self.path])
        self.path, self.runs = path, [0]

    def hits(self) -> DataFrame:
        """(digest, id, n) of digests that stand for several rows; of a compacted index."""
        if self.runs != [0]:
            raise ValueError("the index must be compacted first")
        return self.table().drop("run").where("n > 1")


def exact_dedup(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """All rows and columns of docs plus keep_id, group_size, kept and text_sha256.

    Texts are equal when their bytes are; null counts as empty. Rows that repeat both id and text are one document
    named twice: they count in group_size and share the verdict. A null doc_id never wins over another one; a group
    of null ids only keeps all its rows. An empty table gives an empty result. Columns of docs that bear the name of
    a result column are replaced by it.
    """
    spark = docs.sparkSession
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    rows = boxed(docs, _doc=F.col("doc_id").cast("long"), _text=F.coalesce("text", F.lit("")), _digest=digest_of(F.col("text"), params))
    paths: list[str] = []
    index = DigestIndex(spark, shared_path(spark, "runs"), params)
    index.flush(docs)
    index.compact()
    kept: list[str] = []  # what the result is read from
    hits = written(index.hits().select("digest", F.col("id").alias("_id"), F.col("n").alias("_n")), "hits", kept)
    drop_paths(spark, [index.path])
    bits = filter_bits(hits.count(), params.most_bits)
    passes = written(hit_filter(hits, bits), "filter", kept)
    marked = with_mark(rows, "_digest", passes, bits)
    alone = marked.where("not _maybe").withColumn("_id", F.col("_doc")).withColumn("_n", F.lit(1).cast("long"))
    # The index answers; documents that only the filter took for hits stay alone.
    found = marked.where("_maybe").join(hits, F.col("_digest") == F.col("digest"), "left").drop("digest")
    # Byte verification: texts of one digest are told apart by their bytes; equal ones meet in the map-side combine.
    checked = marked.where("_maybe").groupBy(F.col("_digest").alias("digest"), F.col("_text").alias("bytes")).agg(index.best("_doc").alias("id"), F.count(F.lit(1)).alias("n"))
    clash = written(checked.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "clash", paths)
    if not clash.isEmpty():
        own = written(checked.join(clash, "digest", "left_semi").select("digest", "bytes", F.col("id").alias("_own"), F.col("n").alias("_m")), "own", kept)
        found = found.join(own, (F.col("_digest") == F.col("digest")) & (F.col("_text") == F.col("bytes")), "left")
        found = found.withColumn("_id", F.coalesce("_own", "_id")).withColumn("_n", F.coalesce("_m", "_n")).drop("digest", "bytes", "_own", "_m")
    drop_paths(spark, paths)
    found = found.withColumn("_n", F.coalesce("_n", F.lit(1)).cast("long")).withColumn("_id", F.when(F.col("_n") == 1, F.col("_doc")).otherwise(F.col("_id")))
    both = alone.unionByName(found)
    sha = F.lower(F.hex(F.col("_digest"))) if params.digest_bytes == 32 else F.sha2(F.col("_text"), 256)
    kept = F.col("_doc").eqNullSafe(F.col("_id"))
    return both.select("_row.*", F.col("_id").alias("keep_id"), F.col("_n").alias("group_size"), kept.alias("kept"), sha.alias("text_sha256"))
