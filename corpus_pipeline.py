"""A training-corpus pipeline: quality rules, exact dedup, near-dedup, mixing to target weights, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns each mixed document's ids. STAGES are written as Parquet and read again between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import boxed, written
from lodevec.llm.exact_dedup import exact_dedup, filter_bits, hit_filter, with_mark
from lodevec.llm.mixing import mix
from lodevec.llm.near_dedup import near_dedup
from lodevec.llm.pieces import PieceModel, encoded
from lodevec.llm.quality import fit, score
from lodevec.llm.queries import TOKENIZERS, table

#: Not stated in SQL: hashed ratios, sketches, keyed draws and piece encoding are tested against brute force instead.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    judged = score(boxed(docs, text=F.col("text")), model, keep=["_row"])
    return judged.where("kept").select("_row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    judged = exact_dedup(boxed(docs, doc_id=F.col("doc_id"), text=F.col("text")))
    return judged.where("kept").select("_row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    dropped = written(near_dedup(docs).where("not kept").select(F.col("doc_id").cast("long").alias("_dropped")).distinct(), "dropped")
    # A filter of bounded size: texts of documents that it doesn't have stay where they are.
    bits = filter_bits(dropped.count())
    passes = written(hit_filter(dropped.toDF("digest"), bits), "filter")
    marked = with_mark(boxed(docs, _id=F.col("doc_id").cast("long")), "_id", passes, bits)
    sure, maybe = marked.where("not _maybe"), marked.where("_maybe")
    return sure.unionByName(maybe.join(dropped, F.col("_id") == F.col("_dropped"), "left_anti")).select("_row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as it is taken, in shards that are shuffled locally."""
    return mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_ids of every mixed row."""
    return encoded(docs, PieceModel.load(f"{TOKENIZERS}/piece_bpe_32k.model"), keep=["doc_id", "source"])


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("piece encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
