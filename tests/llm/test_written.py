"""Intermediate tables are read back whole."""

from pyspark.sql import functions as F

from lodevec.llm.common import drop_paths, written


def test_codec_of_intermediate_tables(spark):
    rows = spark.range(0, 20_000, 1, 2).select("id", F.repeat(F.lit("ab "), (F.col("id") % 90).cast("int")).alias("text"))
    paths: list[str] = []
    back = written(rows, "codec", paths)
    files = back.inputFiles()
    # Reads of lz4_raw pages failed (MalformedInputException) in op5_source_mixing on check_s.
    assert files and all(x.endswith(".zstd.parquet") for x in files)
    assert back.agg(F.count("*"), F.sum("id"), F.sum(F.length("text"))).first() == rows.agg(F.count("*"), F.sum("id"), F.sum(F.length("text"))).first()
    drop_paths(spark, paths)
