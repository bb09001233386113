"""Queries of the vector engine that do the whole job, against exact results."""

from pyspark.sql import functions as F

from lodevec.operators import search
from lodevec.operators.index import dense_positions
from lodevec.queries import D, K, QUERIES, WHOLE, asked, token_spans, vectors


def test_trained_search_finds_the_neighbours(spark, tiny):
    import __spark_entry__

    assert set(WHOLE) <= set(__spark_entry__.queries())
    e = vectors(spark, tiny)
    found = WHOLE["ann_search_trained"](spark, tiny)
    assert search.recall(found, search.exact_knn(e, asked(e), D, K), K).first()[0] >= 0.9
    assert found.groupBy("qid").count().where(f"count = {K}").count() == asked(e).count()
    assert WHOLE["recall_at_k_trained"](spark, tiny).first()[0] >= 0.9
    assert WHOLE["refine_pages_trained"](spark, tiny).where("pages >= requests and requests > 0").count() == asked(e).count()


def test_trained_search_gives_the_tables_ids(spark, tiny, tmp_path):
    """Ids with gaps, not the index's dense ones."""
    at = str(tmp_path)
    spark.read.parquet(f"{tiny}/embeddings.parquet").selectExpr("vec_id * 10 + 5 as vec_id", "embedding").unionAll(spark.read.parquet(f"{tiny}/embeddings.parquet").where("vec_id < 40").selectExpr("vec_id * 20 as vec_id", "embedding")).write.parquet(f"{at}/embeddings.parquet")
    found = WHOLE["ann_search_trained"](spark, at).where("rank = 1").collect()
    assert len(found) == 40 and sum(r.id in (r.qid, r.qid // 2 + 5) for r in found) > 36


def test_positions_of_wide_rows_are_dense(spark):
    """Both sides of the join must see the same ranges, though one is wide and the other narrow."""
    wide = spark.range(0, 120_000, 3, 16).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.xxhash64("id", i)).alias("embedding")).repartition(7)
    got = dense_positions(wide, "id")
    right = got.where("_pos = id div 3").agg(F.count(F.lit(1)), F.sum(F.size("embedding"))).first()  # reads the wide column
    assert tuple(right) == (40_000, 40_000 * 64)


def test_trained_inner_products(spark, tiny):
    """Uneven groups, a rotation, a mean and a compact router, by inner product."""
    assert WHOLE["recall_at_k_inner"](spark, tiny).first()[0] >= 0.9
    assert WHOLE["ann_search_inner"](spark, tiny).where("distance > 0").count() == 0  # the nearest have positive products


def test_trained_layout(spark, tiny):
    rows = WHOLE["trained_layout"](spark, tiny).collect()
    assert sorted(r.group for r in rows) == list(range(24)) and sum(r.dimensions for r in rows) == D
    assert abs(sum(r.bits for r in rows) - 96) < 1e-3


def test_every_token_is_mapped(spark, tiny):
    total = QUERIES["token_range_join"](spark, tiny).count()
    assert total == token_spans(spark, tiny).agg(F.sum("size")).first()[0]
