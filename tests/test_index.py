import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec.functions import vectors as V
from lodevec.operators import quantizer, search
from lodevec.operators.index import VectorIndex, dense_positions, swap_plan
from lodevec.plans.config import IndexConfig, SearchParams


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 8)).astype(np.float32) * np.geomspace(4, 0.5, 8).astype(np.float32)
    x[250:260] = x[0]
    x[299] = 0
    return x


@pytest.fixture(scope="module")
def e(spark, rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, embedding array<float>").repartition(5)


@pytest.fixture(scope="module")
def q(e):
    return e.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qv"))


def truth(rows, metric, k):
    out = {}
    for i in range(0, 300, 20):
        x, y = rows.astype(float), rows[i].astype(float)
        d = ((x - y) ** 2).sum(1) if metric == "l2" else -(x @ y)
        out[i] = sorted(zip(d.round(6), range(300)))[:k]
    return out


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_exact_knn(e, q, rows, metric):
    got = {}
    for r in search.exact_knn(e, q, 8, 5, metric, block=4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((round(r.distance, 6), r.id))
    want = truth(rows, metric, 5)
    assert {k: [round(d, 4) for d, _ in v] for k, v in got.items()} == {k: [round(d, 4) for d, _ in v] for k, v in want.items()}
    assert [i for _, i in got[0]] == [0, 250, 251, 252, 253] if metric == "l2" else True


@pytest.mark.parametrize("kind", [dict(grouping="uneven", transform="pca"), dict(transform="balanced_pca", router="pq4", metric="ip"), dict(metric="cosine", centering="none")])
def test_index_life(spark, e, q, rows, tmp_path, kind):
    index = VectorIndex.create(spark, str(tmp_path / "i"), IndexConfig(8, 4, **kind)).fit(e.where("id < 299") if kind.get("metric") == "cosine" else e)
    with pytest.raises(ValueError):
        index.fit(e)
    assert index.insert(e) == 300 and index.size() == index.next_id() == 300
    assert index.insert(e.limit(0)) == 0
    spots = index.locations().collect()
    assert sorted(r.id for r in spots) == list(range(300))
    by_list = {}
    for r in sorted(spots, key=lambda r: (r.list_no, r.offset)):
        by_list.setdefault(r.list_no, []).append((r.offset, r.id))
    for n, held in by_list.items():
        assert [o for o, _ in held] == list(range(index.list_size(n))) and [i for _, i in held] == sorted(i for _, i in held)
    # All lists and no limit: a wide interval leaves all rows, so the search is exact.
    asked = q.where("qid < 280") if kind.get("metric") == "cosine" else q
    wide = SearchParams(5, 16, 1e6, 0)
    metric = kind.get("metric", "l2")
    if metric != "cosine":
        found = index.search(asked, wide)
        assert search.recall(found, search.exact_knn(e, asked, 8, 5, metric), 5).first()[0] == 1.0
    stats = index.search_stats(asked, SearchParams(5, 4, 1.0, 50)).collect()
    assert all(r.candidates >= 5 and r.scanned <= r.padded and r.requests <= r.pages for r in stats)
    # Deletes: all or nothing, ids are not given again.
    for bad in ([1, 1], [5, 300], [None]):
        with pytest.raises(ValueError):
            index.erase(spark.createDataFrame([(x,) for x in bad], "id long"))
    assert index.size() == 300 and index.erase(e.limit(0).select("id")) == 0
    gone = e.where("id % 3 = 0").select("id")
    assert index.erase(gone) == 100 and index.size() == 200
    left = index.locations().collect()
    assert sorted(r.id for r in left) == [i for i in range(300) if i % 3]
    for n in {r.list_no for r in left}:
        assert sorted(r.offset for r in left if r.list_no == n) == list(range(index.list_size(n)))
    with pytest.raises(ValueError):
        index.erase(gone)
    index.checkpoint()
    again = VectorIndex.open(spark, str(tmp_path / "i"))
    assert again.size() == 200 and again.next_id() == 300
    first = again.search(asked, SearchParams(3, 8)).orderBy("qid", "rank").collect()
    assert first == index.search(asked, SearchParams(3, 8)).orderBy("qid", "rank").collect()
    assert again.insert(e.limit(7)) == 7 and again.next_id() == 307
    # What wasn't published isn't there after opening anew.
    assert VectorIndex.open(spark, str(tmp_path / "i")).size() == 200


def test_many_rows_are_all_stored(spark, tmp_path):
    """Several files and parts of a list: what insert returns is what is there, ids are 0 to n - 1."""
    n = 400_000
    many = spark.range(0, n, 1, 8).select((F.col("id") * 3 + 1).alias("id"), F.array(*(((F.col("id") * k) % 97).cast("float") for k in (1, 5, 11, 31))).alias("embedding"))
    made = VectorIndex.create(spark, str(tmp_path / "many"), IndexConfig(4, 2)).fit(many.where("id < 3000"))
    assert made.insert(many) == n == made.size() == made.next_id()
    one = made.locations().agg(F.count(F.lit(1)), F.count_distinct("id"), F.min("id"), F.max("id")).first()
    assert tuple(one) == (n, n, 0, n - 1)
    places = made.records().groupBy("list_no").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("offset").alias("d"), F.min("offset").alias("low"), F.max("offset").alias("high"))
    assert places.where("n <> d or low <> 0 or high <> n - 1").isEmpty() and made.postings().count() == n
    # The directory agrees with the records, before and after rows are erased and swapped.
    agree = lambda: made.locations().join(made.records().select("id", "list_no", "offset"), ["id", "list_no", "offset"]).count() == made.size()
    assert agree() and made.erase(spark.range(0, n, 7).toDF("id")) == -(-n // 7) and agree()
    by_id = made.records().select("id", F.col("payload")[0].alias("x")).where("x <> id % 97")
    assert by_id.isEmpty()


def test_directory(spark, e, tmp_path):
    made = VectorIndex.create(spark, str(tmp_path / "d"), IndexConfig(8, 4)).fit(e)
    made.insert(e)
    where = {r.id: (r.list_no, r.offset) for r in made.locations().collect()}
    asked = spark.createDataFrame([(3,), (299,), (3,)], "id long")
    assert sorted((r.id, (r.list_no, r.offset)) for r in made.locate(asked).collect()) == [(3, where[3]), (3, where[3]), (299, where[299])]
    with pytest.raises(Exception, match="unknown id"):
        made.locate(spark.range(300, 301)).collect()
    back = made.ids_at(spark.createDataFrame([where[5], where[250]], "list_no int, offset long"))
    assert sorted(r.id for r in back.collect()) == [5, 250]
    with pytest.raises(Exception, match="no such offset"):
        made.ids_at(spark.createDataFrame([(where[5][0], 10_000)], "list_no int, offset long")).collect()
    gone = spark.range(0, 300, 4)
    stats = {r.list_no: r for r in made.erase_stats(gone).collect()}
    assert sum(r.deleted for r in stats.values()) == 75 and all(r.moved <= r.deleted and r.pages_written <= r.pages_read for r in stats.values())
    # A directory that disagrees with the records stops a delete before anything is written.
    at = made.manifest
    wrong = made.locations().withColumn("offset", F.when(F.col("id") == 4, 10_000).otherwise(F.col("offset")))
    made.store.write("locations", 99, wrong.withColumn("part", F.lit(0)).select("part", "id", "list_no", "offset"))
    made.manifest = at | {"parts": {0: [99]}}
    with pytest.raises(ValueError, match="disagrees"):
        made.erase(gone)
    made.manifest = at
    assert made.erase(gone) == 75
    assert {r.id for r in made.locate(spark.range(300)).where("list_no is null").collect()} == set(range(0, 300, 4))


def test_candidates_must_be_enough(spark, e, q):
    few = q.where("qid = 0").select("qid", F.lit(0).alias("list_no"), F.lit(0).cast("long").alias("offset"))
    records = e.select(F.lit(0).alias("list_no"), F.col("id").alias("offset"), "id", F.col("embedding").alias("payload"))
    with pytest.raises(Exception, match="fewer candidates than k"):
        search.refine(few, records, q, SearchParams(2, 1), "l2").collect()


def test_buckets_of_an_uneven_layout(e):
    model = quantizer.train(e, IndexConfig(8, 4, grouping="uneven"))
    held = quantizer.buckets(model)
    assert sum(b["groups"] * b["dimensions"] for b in held) == 8 and sum(b["groups"] for b in held) == 4
    assert [b["code_offset"] for b in held] == [b["first_group"] // 2 for b in held]
    loads = quantizer.group_loads(e, model).collect()
    assert sorted(r.group for r in loads) == [0, 1, 2, 3] and abs(sum(r.bits for r in loads) - 16) < 1e-6


def test_open_needs_an_index(spark, tmp_path):
    with pytest.raises(ValueError):
        VectorIndex.open(spark, str(tmp_path / "none"))


def test_saved_quantizer_is_checked(e):
    model = quantizer.train(e, IndexConfig(8, 4, transform="pca"))
    text = model.to_json()
    assert np.allclose(quantizer.Quantizer.from_json(text).mean, model.mean)
    for bad in ("", text[:50], text.replace('"sha256": "', '"sha256": "0')):
        with pytest.raises(ValueError):
            quantizer.Quantizer.from_json(bad)


def test_codes_pack_and_decode(e, rows):
    model = quantizer.train(e, IndexConfig(8, 4))
    codes, *meta = model.encode_array(rows.astype(float))
    assert (quantizer.unpacked(quantizer.packed(codes)) == codes).all()
    decoded = model.decode_array(codes, *meta)
    error = np.linalg.norm(decoded - rows, axis=1) / np.maximum(np.linalg.norm(rows - model.mean, axis=1), 1e-9)
    assert np.median(error) < 0.8
    codes, norm_c, scale_c, err_c = model.encode_array(model.mean[None])  # a zero direction
    assert norm_c[0] == 0 and scale_c[0] == 0


def test_rounded_tables_stay_near(e, rows):
    model = quantizer.train(e, IndexConfig(8, 4))
    codes, *meta = model.encode_array(rows.astype(float))
    query, decoded = model.query(rows[:3].astype(float)), model.decoded_metadata(*meta)
    for i in range(3):
        exact, rough = (model.estimates(query, i, codes, decoded, lut)[0] for lut in ("exact", "uint8"))
        assert np.abs(exact - rough).max() < 0.05 * max(1.0, np.abs(exact).max())
    layout = quantizer.layout_frame(e, model).collect()
    assert sorted(r.dimension for r in layout) == list(range(8)) and abs(sum(r.bits for r in layout) - 16) < 1e-9


def test_vectors_of_a_wrong_length_fail(spark, e):
    with pytest.raises(Exception, match="vectors must have"):
        quantizer.train(e.union(spark.createDataFrame([(900, [1.0])], "id long, embedding array<float>")), IndexConfig(8, 4))


def test_interval_rules(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, 0, 1.0, 0.5), (1, 1, 2.0, 0.0), (1, 2, 2.4, 1.0), (1, 3, 9.0, inf), (1, 4, 2.4, 1.0), (1, 5, 9.5, 0.1), (1, 6, nan, 0.0)]
    rows = spark.createDataFrame(data, "qid long, token long, est double, unc double")
    pick = lambda **kw: [r.token for r in search.interval_select(rows, SearchParams(**{"k": 2, "nprobe": 1} | kw)).orderBy("rank").collect()]
    assert pick(limit=0) == [0, 1, 2, 4, 3]  # theta is 2.0; the endless interval reaches down to it
    assert pick(limit=3) == [0, 1, 2]  # ties by token, and the bound comes after the cut
    assert pick(limit=0, z=0.0) == [0, 1]
    with pytest.raises(Exception, match="fewer rows than k"):
        search.interval_select(rows, SearchParams(8, 1, 1.0, 0)).collect()
    assert search.interval_select(rows, SearchParams(8, 1, 1.0, 0), strict=False).count() == 7


def test_column_helpers(spark):
    row = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("a"), F.array(F.lit(0.0), F.lit(4.0)).alias("b"))
    out = row.select(V.norm(F.col("a")), V.l2_squared(F.col("a"), F.col("b")), V.distance("cosine", F.col("a"), F.col("a")), V.distance("ip", F.col("a"), F.col("b"))).first()
    assert tuple(out) == (5.0, 9.0, 0.0, -16.0)
    code = lambda v, m: spark.range(1).select(V.quantized(F.lit(v), F.lit(m), F.lit(m / 254 if m else 1.0))).first()[0]
    assert [code(0.0, 1.0), code(1.0, 1.0), code(1.1, 1.0), code(float("nan"), 1.0), code(0.2, 0.0)] == [0, 254, 255, 255, 0]


def test_swap_plan(spark):
    rows = spark.createDataFrame([(0, o, 10 + o) for o in range(6)] + [(1, 0, 99)], "list_no int, offset long, id long")
    moves = lambda gone: sorted((r.id, r.from_offset, r.to_offset) for r in swap_plan(rows.where(F.col("id").isin(gone)), rows).collect())
    assert moves([10, 12]) == [(14, 4, 2), (15, 5, 0)]
    assert moves([15]) == [] and moves([10, 11, 12, 13, 14, 15, 99]) == [] and moves([14, 10]) == [(15, 5, 0)]


def test_dense_positions(spark):
    df = spark.range(0, 1000, 7).repartition(6)
    assert sorted((r.id, r._pos) for r in dense_positions(df, "id").collect()) == [(7 * i, i) for i in range(143)]
