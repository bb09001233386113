"""Queries of the vector engine over the embeddings table, and the same in SQL.

Queries use a model that SQL can tell as well: the first 16 vectors are the lists' centroids, and the first 16 unit
directions the codebooks; no centring, no rotation, 16 groups of 4 dimensions. The query vectors are all rows whose id
is divisible by 20.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodevec.functions.vectors import norm
from lodevec.operators import index, quantizer, router, search
from lodevec.plans.config import IndexConfig, SearchParams
from lodevec.sources.store import shared_path

#: The model that SQL can tell finds about half of the true neighbours; TRAINED and DEEP are the search to use.
D, M, NLIST, K, NPROBE, LIMIT = 64, 16, 16, 10, 4, 100


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def asked(e: DataFrame) -> DataFrame:
    return e.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qv"))


def config(metric: str = "l2", **more) -> IndexConfig:
    return IndexConfig(D, M, **{"metric": metric, "centering": "none", "init": "first_rows", "nlist": NLIST} | more)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def knn_exact(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = vectors(spark, sf_dir)
        return rounded(search.exact_knn(e, asked(e), D, K, metric), "distance")

    return run


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir)
    return router.assign(e, router.train_centroids(e, config()))


def ivf_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select(F.col("id").alias("vec_id"), "list_no")


def ivf_list_sizes(spark, sf_dir):
    return assigned(spark, sf_dir).groupBy("list_no").agg(F.count(F.lit(1)).alias("size"))


def ivf_route(spark, sf_dir):
    e = vectors(spark, sf_dir)
    return router.route(asked(e), router.train_centroids(e, config()), NPROBE)


def ivf_flat_search(spark, sf_dir):
    e, probes = assigned(spark, sf_dir), ivf_route(spark, sf_dir)
    records = e.withColumn("offset", F.col("id")).withColumnRenamed("embedding", "payload")
    inside = probes.join(records.select("list_no", "offset"), "list_no")
    return rounded(search.refine(inside, records, asked(vectors(spark, sf_dir)), SearchParams(K, NPROBE), "l2"), "distance")


def placed(spark, sf_dir) -> DataFrame:
    e = assigned(spark, sf_dir)
    ids = index.dense_positions(e, "id").select(F.col("_pos").alias("logical_id"), F.col("id").alias("vec_id"), "list_no", F.col("_pos").alias("id"))
    return index.append_offsets(ids, spark.createDataFrame([], "list_no int, size long"))


def insert_offsets(spark, sf_dir):
    per_page = config().records_per_page
    return placed(spark, sf_dir).select("vec_id", "logical_id", "list_no", "offset", F.floor(F.col("offset") / per_page).alias("page"), (F.col("offset") % per_page).alias("slot"))


def insert_pages(spark, sf_dir):
    per_page = config().records_per_page
    return ivf_list_sizes(spark, sf_dir).select("list_no", F.col("size").alias("rows"), F.ceil(F.col("size") / per_page).alias("pages"), (F.ceil(F.col("size") / 32) * 32).alias("padded"))


def delete_swap_plan(spark, sf_dir):
    """The plan for deleting all query vectors, those whose id is divisible by 20."""
    rows = placed(spark, sf_dir).select("list_no", "offset", F.col("logical_id").alias("id"), "vec_id")
    return index.swap_plan(rows.where("vec_id % 20 = 0").drop("vec_id"), rows.drop("vec_id")).withColumnRenamed("id", "moved_id")


def location_lookup(spark, sf_dir):
    """Every id of the table, and unknown ones beyond: one and a hundredth of the rows."""
    at = placed(spark, sf_dir).select(F.col("logical_id").alias("id"), "list_no", "offset")
    n = vectors(spark, sf_dir).count()
    return spark.range(0, n + 1 + n // 100).join(at, "id", "left")


def vector_mean(spark, sf_dir):
    e = vectors(spark, sf_dir)
    return e.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def mean_norm_direction(spark, sf_dir):
    """Norm and whole unit direction of each centred vector, a row for each dimension."""
    e = vectors(spark, sf_dir)
    means = e.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean")).agg(F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("m"))
    centred = e.join(F.broadcast(means)).select(F.col("id").alias("vec_id"), F.zip_with(F.col("embedding").cast("array<double>"), F.col("m.mean"), lambda x, y: x - y).alias("c"))
    sized = centred.withColumn("norm", norm(F.col("c"))).select("vec_id", "norm", F.posexplode("c").alias("dim", "x"))
    return rounded(sized.withColumn("x", F.when(F.col("norm") > 1e-12, F.col("x") / F.col("norm")).otherwise(0.0)), "norm", "x")


def bit_budgets(spark, sf_dir):
    e = vectors(spark, sf_dir)
    var = e.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))
    every = W.partitionBy(F.lit(0))
    h = var.withColumn("h", 0.5 * F.log2(F.greatest(F.col("variance"), F.max("variance").over(every) * 1e-12)))
    order = every.orderBy(F.desc("h"), "dim")
    level = h.withColumn("level", (F.sum("h").over(order.rowsBetween(W.unboundedPreceding, 0)) - 4 * M) / F.row_number().over(order)).withColumn("k", F.row_number().over(order))
    chosen = F.max_by(F.when(F.col("h") >= F.col("level"), F.col("level")), F.when(F.col("h") >= F.col("level"), F.col("k"))).over(every)
    return level.withColumn("chosen", chosen).select("dim", F.round("variance", 8).alias("variance"), (F.round(F.greatest(F.lit(0.0), F.col("h") - F.col("chosen")), 6) + 0.0).alias("bits"))


def coded(spark, sf_dir, metric="l2"):
    e = vectors(spark, sf_dir)
    model = quantizer.train(e, config(metric))
    return e, model, quantizer.encode(e, model)


def pq_encode(spark, sf_dir):
    return coded(spark, sf_dir)[2].select(F.col("id").alias("vec_id"), F.hex("code").alias("code"))


def pq_metadata(spark, sf_dir):
    return coded(spark, sf_dir)[2].select(F.col("id").alias("vec_id"), *(F.col(c).cast("int").alias(c) for c in ("norm_c", "scale_c", "err_c")))


def pq_decode(spark, sf_dir):
    """All numbers of each decoded vector, a row for each dimension."""
    _, model, rows = coded(spark, sf_dir)
    return rounded(quantizer.decode(rows, model).select(F.col("id").alias("vec_id"), F.posexplode("embedding").alias("dim", "x")), "x")


def metric_ranges(metric: str):
    def run(spark, sf_dir):
        e = vectors(spark, sf_dir)
        return rounded(quantizer.metadata_ranges(e, quantizer.train(e, config(metric))), "norm_max", "scale_max")

    return run


def lut(name: str, table):
    """Each query's table of numbers by group and code, made where the queries are."""

    def run(spark, sf_dir):
        e = vectors(spark, sf_dir)
        model = quantizer.train(e, config())

        def rows(batches):
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    t = table(model, quantizer.matrix(part.column(1), D))
                    n, groups, codes = t.shape
                    m, c = np.divmod(np.tile(np.arange(groups * codes, dtype=np.int32), n), codes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), groups * codes)), pa.array(m.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(t.ravel())], ["qid", "m", "c", name])

        return rounded(asked(e).mapInArrow(rows, f"qid long, m int, c int, {name} double"), name)

    return run


def append_pages(spark, sf_dir):
    """Pages that appending the rows of odd ids touches, the others being there."""
    odd = F.col("logical_id") % 2
    sizes = placed(spark, sf_dir).groupBy("list_no").agg(F.sum(1 - odd).alias("old"), F.sum(odd).alias("added"))
    return index.append_pages(sizes, config().records_per_page)


def all_estimates(spark, sf_dir, metric="l2", lut="exact", **more) -> DataFrame:
    """All rows as one list, in order of id; token is the place in it."""
    e = vectors(spark, sf_dir)
    model = quantizer.train(e, config(metric, **more))
    rows = quantizer.encode(e, model)
    places = index.dense_positions(rows, "id").withColumn("list_no", F.lit(0)).withColumn("offset", F.col("_pos"))
    out = None
    for block in search.query_blocks(asked(e), D, 2048):
        part = search.estimates(places, model, block, {i: {0: 0} for i in range(len(block.qid))}, lut)
        out = part if out is None else out.union(part)
    return out


def scan_estimates(metric: str, lut: str = "exact", **more):
    def run(spark, sf_dir):
        return rounded(all_estimates(spark, sf_dir, metric, lut, **more).select("qid", "token", "est", "unc"), "est", "unc")

    return run


def interval(params: SearchParams, metric: str = "l2"):
    def run(spark, sf_dir):
        return rounded(search.interval_select(all_estimates(spark, sf_dir, metric), params).select("qid", "rank", "token", "est"), "est")

    return run


def candidate_summary(spark, sf_dir):
    """Per query: rows seen, theta, candidates, and whether the limit cut rows off."""
    est = all_estimates(spark, sf_dir)
    found = search.interval_select(est, SearchParams(K, NPROBE, 1.0, LIMIT)).groupBy("qid").agg(F.first("theta").alias("theta"), F.count(F.lit(1)).alias("candidates"))
    return rounded(est.groupBy("qid").agg(F.count(F.lit(1)).alias("seen")).join(found, "qid").withColumn("truncated", F.col("seen") > LIMIT), "theta")


def token_spans(spark, sf_dir):
    probes, sizes = ivf_route(spark, sf_dir), ivf_list_sizes(spark, sf_dir)
    return search.probes_with_tokens(probes, sizes)


def token_range_join(spark, sf_dir):
    """Every token of the lists that a query probes, and the list and offset that it stands for."""
    spans = token_spans(spark, sf_dir)
    tokens = spans.groupBy("qid").agg(F.max("end").alias("n")).select("qid", F.explode(F.expr("sequence(0L, n - 1)")).alias("token"))
    on = (tokens.qid == spans.qid) & (F.col("token") >= F.col("begin")) & (F.col("token") < F.col("end"))
    return tokens.join(spans, on).select(tokens.qid, "token", "list_no", (F.col("token") - F.col("begin")).alias("offset"))


PLAIN = SearchParams(K, NPROBE, 1.0, LIMIT)
TRAINED, DEEP = IndexConfig(D, 24, grouping="uneven", transform="pca"), SearchParams(K, 12, 1.0, 400)
INNER = IndexConfig(D, 24, metric="ip", grouping="uneven", transform="pca", router="pq4")


def built(spark: SparkSession, e: DataFrame, made: IndexConfig) -> index.VectorIndex:
    """An index of all rows in the shared folder, where what reads it finds it. It numbers rows from 0 in the order of
    their ids."""
    out = index.VectorIndex.create(spark, shared_path(spark, "index"), made).fit(e)
    out.insert(e)
    return out


def named(found: DataFrame, e: DataFrame, column: str = "id") -> DataFrame:
    """found with the table's ids in place of the index's."""
    ids = index.dense_positions(e.select("id"), "id").select(F.col("_pos").alias("_place"), F.col("id").alias("_vec"))
    return found.join(ids, F.col(column) == F.col("_place")).withColumn(column, F.col("_vec")).drop("_place", "_vec")


def searched(made: IndexConfig, params: SearchParams):
    def run(spark, sf_dir):
        e = vectors(spark, sf_dir)
        return rounded(named(built(spark, e, made).search(asked(e), params), e).select("qid", "rank", "id", "distance"), "distance")

    return run


def recalled(made: IndexConfig, params: SearchParams):
    def run(spark, sf_dir):
        e = vectors(spark, sf_dir)
        return rounded(search.recall(searched(made, params)(spark, sf_dir), search.exact_knn(e, asked(e), D, K, made.metric), K), "recall")

    return run


def pages_read(made: IndexConfig, params: SearchParams):
    def run(spark, sf_dir):
        e = vectors(spark, sf_dir)
        return built(spark, e, made).search_stats(asked(e), params).select("qid", "pages", "requests", "requested_bytes", "opened_files")

    return run


def erased(spark: SparkSession, e: DataFrame) -> tuple[index.VectorIndex, DataFrame]:
    """An index and the index's ids of all query vectors."""
    ids = index.dense_positions(e.select("id"), "id").where("id % 20 = 0").select(F.col("_pos").alias("id"))
    return built(spark, e, config()), ids


def index_insert(spark, sf_dir):
    """Where insertion puts each row, from the directory."""
    e = vectors(spark, sf_dir)
    return named(built(spark, e, config()).locations().withColumn("logical_id", F.col("id")), e).withColumnRenamed("id", "vec_id")


def index_erase(spark, sf_dir):
    """Where the rows are that stay when all query vectors are erased."""
    e = vectors(spark, sf_dir)
    made, ids = erased(spark, e)
    made.erase(ids)
    return named(made.locations(), e).withColumnRenamed("id", "vec_id")


def index_erase_pages(spark, sf_dir):
    """Rows and pages that erasing all query vectors touches."""
    made, ids = erased(spark, vectors(spark, sf_dir))
    return made.erase_stats(ids)


def index_locate(spark, sf_dir):
    """Every id that was given, after all query vectors are erased: null where it is gone."""
    e = vectors(spark, sf_dir)
    made, ids = erased(spark, e)
    made.erase(ids)
    return made.locate(spark.range(made.next_id()))


def index_reload(spark, sf_dir):
    """Codes, metadata and pages of all rows, read from an index that was saved and opened anew."""
    e = vectors(spark, sf_dir)
    made = built(spark, e, config())
    made.checkpoint()
    again = index.VectorIndex.open(spark, made.store.root)
    rows = again.records().select("list_no", "offset", "page_no", "id").join(again.postings(), ["list_no", "offset"])
    return named(rows, e).select(F.col("id").alias("vec_id"), "list_no", "offset", "page_no", F.hex("code").alias("code"), *(F.col(c).cast("int").alias(c) for c in ("norm_c", "scale_c", "err_c")))


def trained_layout(spark, sf_dir):
    """What the uneven layout asks of each group: its dimensions and the sum of their bits."""
    e = vectors(spark, sf_dir)
    return rounded(quantizer.group_loads(e, quantizer.train(e, TRAINED)), "bits")


# SQL, in parts that build on each other. Vectors are lists of doubles summed in index order.
def _sum(expr: str, n: int = D) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: {expr}))"


_E = f"""e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
q AS (SELECT id AS qid, v FROM e WHERE id % 20 = 0),
cent AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS list_no, v FROM e ORDER BY id LIMIT {NLIST}),
"""
_L2 = _sum("(a.v[i] - b.v[i]) * (a.v[i] - b.v[i])")
_IVF = f"""near AS (SELECT a.id, a.v, b.list_no FROM e a, cent b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_L2}, b.list_no) = 1),
probe AS (SELECT a.qid, a.v, b.list_no, row_number() OVER (PARTITION BY a.qid ORDER BY {_L2}, b.list_no) AS probe_rank FROM q a, cent b QUALIFY probe_rank <= {NPROBE}),
place AS (SELECT id, v, list_no, row_number() OVER (ORDER BY id) - 1 AS logical_id, row_number() OVER (PARTITION BY list_no ORDER BY id) - 1 AS off FROM near),
size AS (SELECT list_no, count(*) AS size FROM near GROUP BY list_no),
span AS (SELECT qid, probe_rank, list_no, size, sum(size) OVER (PARTITION BY qid ORDER BY probe_rank)::BIGINT AS "end" FROM probe JOIN size USING (list_no)),
"""


def _knn(expr: str) -> str:
    return f"WITH {_E} r AS (SELECT a.qid, b.id, {expr} AS d FROM q a, e b) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, id)::INTEGER AS rank, id, round(d, 6) + 0.0 AS distance FROM r QUALIFY rank <= {K}"


def _pq(metric: str = "l2", centred: bool = False) -> str:
    """centred: the mean is taken off before anything else; the vectors themselves stay in w."""
    source = f"(SELECT id, v AS w, list_transform(range(1, {D + 1}), lambda i: v[i] - mean[i]) AS v FROM e, mean)" if centred else "(SELECT id, v AS w, v FROM e)"
    means = "mean AS (SELECT list(x ORDER BY d) AS mean FROM (SELECT d, avg(v[d + 1]) AS x FROM e, range(64) t(d) GROUP BY d)),\n" if centred else ""
    scale = "1.0 / rn" if metric == "cosine" else "n / rn"
    code = lambda v: f"(CASE WHEN {v} > {v}_max + 0.5 * {v}_max / 254 THEN 255 ELSE least(254, greatest(0, round({v} / ({v}_max / 254)))) END)::INTEGER"
    return f"""{means}u0 AS (SELECT id, v, sqrt({_sum("v[i] * v[i]")}) AS n FROM {source}),
unit AS (SELECT id, v, n, list_transform(v, lambda x: x / n) AS u FROM u0),
book AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, u FROM unit ORDER BY id LIMIT 16),
code1 AS (SELECT a.id, m, b.c, b.u[4 * m + 1 : 4 * m + 4] AS part FROM unit a, range({M}) t(m), book b
          QUALIFY row_number() OVER (PARTITION BY a.id, m ORDER BY {_sum("(a.u[4 * m + i] - b.u[4 * m + i]) * (a.u[4 * m + i] - b.u[4 * m + i])", 4)}, b.c) = 1),
code AS (SELECT id, list(c ORDER BY m) AS codes, flatten(list(part ORDER BY m)) AS r FROM code1 GROUP BY id),
raw AS (SELECT unit.*, codes, r, sqrt({_sum("r[i] * r[i]")}) AS rn FROM unit JOIN code USING (id)),
meta AS (SELECT *, {scale} AS scale, sqrt({_sum("(u[i] - r[i] / rn) * (u[i] - r[i] / rn)")}) AS err FROM raw),
lim AS (SELECT *, max(n) OVER () AS n_max, max(scale) OVER () AS scale_max FROM meta),
enc AS (SELECT *, {code("n")} AS norm_c, {code("scale")} AS scale_c, ceil(least(2.0, greatest(0.0, err)) * 127.5 - 1e-7)::INTEGER AS err_c FROM lim),
dec AS (SELECT *, CASE norm_c WHEN 255 THEN n_max ELSE norm_c * (n_max / 254) END AS nd, CASE scale_c WHEN 255 THEN scale_max ELSE scale_c * (scale_max / 254) END AS sd, err_c * 2.0 / 255.0 AS ed,
               row_number() OVER (ORDER BY id) - 1 AS pos FROM enc),
"""


def _est(metric: str, source: str = "q a, dec b", columns: str = "a.qid, b.id, b.pos AS token", rough: bool = False, centred: bool = False) -> str:
    """rough: the tables of dot products on 256 levels; centred: the quantizer took the mean off (inner product only)."""
    if rough:
        return _rough()
    dot = f"list_sum(list_transform(range({M}), lambda m: list_sum(list_transform(range(1, 5), lambda j: a.t[4 * m + j] * b.r[4 * m + j]))))"
    turned = f"list_transform(v, lambda x: x / sqrt({_sum('v[i] * v[i]')}))" if metric == "cosine" else "v"
    est = {"l2": "qn * qn + nd * nd - 2.0 * sd * dot", "ip": "-(qm + sd * dot)", "cosine": "1.0 - sd * dot"}[metric]
    unc = {"l2": "2.0 * nd * qn * ed / 8.0", "ip": "nd * qn * ed / 8.0", "cosine": "ed / 8.0"}[metric]
    open_ = "scale_c = 255" + (" OR norm_c = 255" if metric != "cosine" else "")
    ready = source.replace("q a", "qt a").replace("probe a", "(probe JOIN qt USING (qid)) a")
    offset, means = (_sum("v[i] * mean[i]"), ", mean") if centred else ("0.0", "")
    return f"""qt AS (SELECT qid, {turned} AS t, sqrt({_sum("v[i] * v[i]")}) AS qn, {offset} AS qm FROM q{means}),
dots AS (SELECT {columns}, qn, qm, nd, sd, ed, {open_} AS open, {dot} AS dot FROM {ready}),
est AS (SELECT *, {est} AS est, CASE WHEN open THEN 'Infinity'::DOUBLE ELSE {unc} END AS unc FROM dots),
"""


def _rough() -> str:
    """Estimates with tables rounded to bytes, less each row's least value, on one scale for a query's rows."""
    return f"""cell AS (SELECT a.qid, m, b.c, {_sum('a.v[4 * m + i] * b.u[4 * m + i]', 4)} AS x FROM q a, range({M}) t(m), book b),
least AS (SELECT *, min(x) OVER (PARTITION BY qid, m) AS low FROM cell),
span AS (SELECT qid, max(wide) AS span FROM (SELECT qid, m, max(x) - min(x) AS wide FROM cell GROUP BY qid, m) GROUP BY qid),
lut AS (SELECT qid, list(floor((x - low) * (255 / span) + 0.5) * (span / 255) + low ORDER BY m, c) AS t FROM least JOIN span USING (qid) GROUP BY qid),
qt AS (SELECT qid, t, sqrt({_sum("v[i] * v[i]")}) AS qn FROM q JOIN lut USING (qid)),
dots AS (SELECT a.qid, b.id, b.pos AS token, qn, nd, sd, ed, scale_c = 255 OR norm_c = 255 AS open, list_sum(list_transform(range({M}), lambda m: a.t[16 * m + b.codes[m + 1] + 1])) AS dot FROM qt a, dec b),
est AS (SELECT *, qn * qn + nd * nd - 2.0 * sd * dot AS est, CASE WHEN open THEN 'Infinity'::DOUBLE ELSE 2.0 * nd * qn * ed / 8.0 END AS unc FROM dots),
"""


def _select(z: float, limit: int) -> str:
    up, low = ("est", "est") if z == 0 else (f"est + unc * {z}", f"est - unc * {z}")
    cut = f"QUALIFY row_number() OVER (PARTITION BY qid ORDER BY est, token) <= {limit}" if limit else ""
    return f"""theta AS (SELECT qid, max(hi) AS theta FROM (SELECT qid, {up} AS hi FROM est QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {up}, token) <= {K}) GROUP BY qid),
short AS (SELECT * FROM est {cut}),
cand AS (SELECT short.*, theta, row_number() OVER (PARTITION BY qid ORDER BY est, token)::INTEGER AS rank FROM short JOIN theta USING (qid) WHERE {low} <= theta)
"""


_ANN = f"WITH {_E} {_IVF} {_pq()} held AS (SELECT dec.*, place.list_no, place.off FROM dec JOIN place USING (id)), " + _est("l2", "span s, qt a, held b WHERE a.qid = s.qid AND b.list_no = s.list_no", 'a.qid, b.id, b.list_no, b.off, s."end" - s.size + b.off AS token') + _select(1, LIMIT)
_TOP = f", found AS (SELECT a.qid, b.id, {_L2} AS d FROM cand JOIN q a USING (qid) JOIN e b ON b.id = cand.id), best AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, id)::INTEGER AS rank, id, d FROM found QUALIFY rank <= {K})"
_PER_PAGE = config().records_per_page
_HEX = "array_to_string(list_transform(range(8), lambda m: format('{:02X}', (codes[2 * m + 1] + 16 * codes[2 * m + 2])::INTEGER)), '')"
_MOVES = """left_ AS (SELECT list_no, count(*) FILTER (id % 20 <> 0) AS n, count(*) FILTER (id % 20 = 0) AS gone FROM place GROUP BY list_no),
hole AS (SELECT list_no, off, row_number() OVER (PARTITION BY list_no ORDER BY off) AS i FROM place JOIN left_ USING (list_no) WHERE id % 20 = 0 AND off < n),
tail AS (SELECT list_no, off, logical_id, row_number() OVER (PARTITION BY list_no ORDER BY off DESC) AS i FROM place JOIN left_ USING (list_no) WHERE id % 20 <> 0 AND off >= n),
moves AS (SELECT list_no, logical_id AS moved_id, tail.off AS from_offset, hole.off AS to_offset FROM hole JOIN tail USING (list_no, i)),
"""
_RANGES = "SELECT round(max(n), 6) AS norm_max, round(max(scale), 6) AS scale_max FROM meta"


def _close(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip().rstrip(',')} {select}"


_COSINE = f"greatest(0.0, 1.0 - ({_sum('a.v[i] * b.v[i]')}) / (sqrt({_sum('a.v[i] * a.v[i]')}) * sqrt({_sum('b.v[i] * b.v[i]')})))"
_EST_OUT = "SELECT qid, token, round(est, 6) + 0.0 AS est, round(unc, 6) + 0.0 AS unc FROM est"
_CAND_OUT = "SELECT qid, rank, token, round(est, 6) + 0.0 AS est FROM cand"
_EXPLODED = "x AS (SELECT generate_subscripts(embedding, 1)::INTEGER - 1 AS dim, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings), "

QUERIES = {
    "knn_exact_l2": knn_exact("l2"),
    "knn_exact_cosine": knn_exact("cosine"),
    "knn_exact_ip": knn_exact("ip"),
    "ivf_assign": ivf_assign,
    "ivf_list_sizes": ivf_list_sizes,
    "ivf_route": ivf_route,
    "ivf_flat_search": ivf_flat_search,
    "insert_offsets": insert_offsets,
    "insert_pages": insert_pages,
    "delete_swap_plan": delete_swap_plan,
    "location_lookup": location_lookup,
    "vector_mean": vector_mean,
    "mean_norm_direction": mean_norm_direction,
    "bit_budgets": bit_budgets,
    "pq_encode": pq_encode,
    "pq_metadata": pq_metadata,
    "pq_decode": pq_decode,
    "metric_ranges_l2": metric_ranges("l2"),
    "metric_ranges_cosine": metric_ranges("cosine"),
    "dot_lut": lut("dot", lambda model, q: model.query(q)["table"]),
    "l2_lut": lut("distance", lambda model, q: model.distance_table(q)),
    "append_pages": append_pages,
    "scan_estimates_l2": scan_estimates("l2"),
    "scan_estimates_ip": scan_estimates("ip"),
    "scan_estimates_cosine": scan_estimates("cosine"),
    "interval_select": interval(SearchParams(K, NPROBE, 1.0, LIMIT)),
    "interval_select_uncapped": interval(SearchParams(K, NPROBE, 1.0, 0)),
    "interval_select_z0": interval(SearchParams(K, NPROBE, 0.0, LIMIT)),
    "interval_select_cosine": interval(SearchParams(K, NPROBE, 1.0, LIMIT), "cosine"),
    "candidate_summary": candidate_summary,
    "token_spans": token_spans,
    "token_range_join": token_range_join,
    "refine_pages": pages_read(config(), PLAIN),
    "ann_search": searched(config(), PLAIN),
    "recall_at_k": recalled(config(), PLAIN),
    "scan_estimates_uint8": scan_estimates("l2", "uint8"),
    "scan_estimates_ip_mean": scan_estimates("ip", centering="mean"),
    "index_insert": index_insert,
    "index_erase": index_erase,
    "index_erase_pages": index_erase_pages,
    "index_locate": index_locate,
    "index_reload": index_reload,
}

#: Queries over trained models, which SQL can't tell; tested against exact results.
WHOLE = {
    "ann_search_trained": searched(TRAINED, DEEP),
    "recall_at_k_trained": recalled(TRAINED, DEEP),
    "refine_pages_trained": pages_read(TRAINED, DEEP),
    "ann_search_inner": searched(INNER, DEEP),
    "recall_at_k_inner": recalled(INNER, DEEP),
    "trained_layout": trained_layout,
}

SQL = {
    "knn_exact_l2": _knn(_L2),
    "knn_exact_cosine": _knn(_COSINE),
    "knn_exact_ip": _knn(f"-({_sum('a.v[i] * b.v[i]')})"),
    "ivf_assign": _close(_E + _IVF, "SELECT id AS vec_id, list_no FROM near"),
    "ivf_list_sizes": _close(_E + _IVF, "SELECT list_no, size FROM size"),
    "ivf_route": _close(_E + _IVF, "SELECT qid, probe_rank::INTEGER AS probe_rank, list_no FROM probe"),
    "ivf_flat_search": _close(_E + _IVF, f"SELECT a.qid, row_number() OVER (PARTITION BY a.qid ORDER BY {_L2}, b.id)::INTEGER AS rank, b.id, round({_L2}, 6) + 0.0 AS distance FROM probe a JOIN near b USING (list_no) QUALIFY rank <= {K}"),
    "insert_offsets": _close(_E + _IVF, f"SELECT id AS vec_id, logical_id, list_no, off AS \"offset\", off // {_PER_PAGE} AS page, off % {_PER_PAGE} AS slot FROM place"),
    "insert_pages": _close(_E + _IVF, f"SELECT list_no, size AS rows, ceil(size / {_PER_PAGE})::BIGINT AS pages, (ceil(size / 32) * 32)::BIGINT AS padded FROM size"),
    "delete_swap_plan": _close(_E + _IVF + _MOVES, "SELECT * FROM moves"),
    "location_lookup": _close(_E + _IVF, "SELECT r.id, list_no, off AS \"offset\" FROM range((SELECT count(*) + 1 + count(*) // 100 FROM e)) r(id) LEFT JOIN place ON place.logical_id = r.id"),
    "vector_mean": _close(_EXPLODED, "SELECT dim, round(avg(x), 6) AS mean FROM x GROUP BY dim"),
    "mean_norm_direction": _close(_EXPLODED + f"m AS (SELECT dim, avg(x) AS mean FROM x GROUP BY dim), c AS (SELECT vec_id, list(x - mean ORDER BY dim) AS c FROM x JOIN m USING (dim) GROUP BY vec_id), n AS (SELECT vec_id, c, sqrt({_sum('c[i] * c[i]')}) AS n FROM c)", f"SELECT vec_id, round(n, 6) + 0.0 AS norm, d::INTEGER AS dim, round(CASE WHEN n > 1e-12 THEN c[d + 1] / n ELSE 0 END, 6) + 0.0 AS x FROM n, range({D}) t(d)"),
    "bit_budgets": _close(_EXPLODED + f"""v AS (SELECT dim, var_pop(x) AS variance FROM x GROUP BY dim), h AS (SELECT *, 0.5 * log2(greatest(variance, max(variance) OVER () * 1e-12)) AS h FROM v),
        l AS (SELECT *, row_number() OVER (ORDER BY h DESC, dim) AS k, (sum(h) OVER (ORDER BY h DESC, dim ROWS UNBOUNDED PRECEDING) - {4 * M}) / row_number() OVER (ORDER BY h DESC, dim) AS level FROM h)""", "SELECT dim, round(variance, 8) AS variance, round(greatest(0.0, h - (SELECT level FROM l WHERE h >= level ORDER BY k DESC LIMIT 1)), 6) + 0.0 AS bits FROM l"),
    "pq_encode": _close(_E + _pq(), f"SELECT id AS vec_id, {_HEX} AS code FROM enc"),
    "pq_metadata": _close(_E + _pq(), "SELECT id AS vec_id, norm_c, scale_c, err_c FROM enc"),
    "pq_decode": _close(_E + _pq(), f"SELECT id AS vec_id, d::INTEGER AS dim, round(r[d + 1] * sd, 6) + 0.0 AS x FROM dec, range({D}) t(d)"),
    "metric_ranges_l2": _close(_E + _pq(), _RANGES),
    "metric_ranges_cosine": _close(_E + _pq("cosine"), _RANGES),
    "dot_lut": _close(_E + _pq(), f"SELECT a.qid, m::INTEGER AS m, b.c::INTEGER AS c, round({_sum('a.v[4 * m + i] * b.u[4 * m + i]', 4)}, 6) + 0.0 AS dot FROM q a, range({M}) t(m), book b"),
    "l2_lut": _close(_E + _pq(), f"SELECT a.qid, m::INTEGER AS m, b.c::INTEGER AS c, round({_sum('(a.v[4 * m + i] - b.u[4 * m + i]) * (a.v[4 * m + i] - b.u[4 * m + i])', 4)}, 6) + 0.0 AS distance FROM q a, range({M}) t(m), book b"),
    "append_pages": _close(_E + _IVF, f""", s AS (SELECT list_no, count(*) FILTER (logical_id % 2 = 0) AS old, count(*) FILTER (logical_id % 2 = 1) AS added FROM place GROUP BY list_no)
        SELECT list_no, (old % {_PER_PAGE} <> 0)::BIGINT AS pages_read, (ceil((old + added) / {_PER_PAGE}) - ceil(old / {_PER_PAGE}))::BIGINT + (old % {_PER_PAGE} <> 0)::BIGINT AS pages_written FROM s WHERE added > 0"""),
    "scan_estimates_l2": _close(_E + _pq() + _est("l2"), _EST_OUT),
    "scan_estimates_ip": _close(_E + _pq("ip") + _est("ip"), _EST_OUT),
    "scan_estimates_cosine": _close(_E + _pq("cosine") + _est("cosine"), _EST_OUT),
    "interval_select": _close(_E + _pq() + _est("l2") + _select(1, LIMIT), _CAND_OUT),
    "interval_select_uncapped": _close(_E + _pq() + _est("l2") + _select(1, 0), _CAND_OUT),
    "interval_select_z0": _close(_E + _pq() + _est("l2") + _select(0, LIMIT), _CAND_OUT),
    "interval_select_cosine": _close(_E + _pq("cosine") + _est("cosine") + _select(1, LIMIT), _CAND_OUT),
    "candidate_summary": _close(_E + _pq() + _est("l2") + _select(1, LIMIT), f"SELECT qid, (SELECT count(*) FROM e) AS seen, round(any_value(theta), 6) + 0.0 AS theta, count(*) AS candidates, (SELECT count(*) FROM e) > {LIMIT} AS truncated FROM cand GROUP BY qid"),
    "token_spans": _close(_E + _IVF, 'SELECT qid, probe_rank::INTEGER AS probe_rank, list_no, size, "end", "end" - size AS "begin" FROM span'),
    "token_range_join": _close(_E + _IVF, ', t AS (SELECT qid, unnest(range(0, max("end"))) AS token FROM span GROUP BY qid) SELECT t.qid, token, list_no, token - ("end" - size) AS "offset" FROM t JOIN span s ON t.qid = s.qid AND token >= "end" - size AND token < "end"'),
    "refine_pages": _ANN + f", pages AS (SELECT DISTINCT qid, list_no, off // {_PER_PAGE} AS page FROM cand), runs AS (SELECT *, lag(page) OVER (PARTITION BY qid, list_no ORDER BY page) AS before FROM pages) SELECT qid, count(*) AS pages, count(*) FILTER (before IS NULL OR page <> before + 1) AS requests, count(*) * 4096 AS requested_bytes, count(DISTINCT list_no) AS opened_files FROM runs GROUP BY qid",
    "ann_search": _ANN + _TOP + " SELECT qid, rank, id, round(d, 6) + 0.0 AS distance FROM best",
    "recall_at_k": _ANN + _TOP + f", truth AS (SELECT a.qid, b.id FROM q a, e b QUALIFY row_number() OVER (PARTITION BY a.qid ORDER BY {_L2}, b.id) <= {K}) SELECT round(count(best.id) / count(*), 6) AS recall FROM truth LEFT JOIN best USING (qid, id)",
    "scan_estimates_uint8": _close(_E + _pq() + _est("l2", rough=True), _EST_OUT),
    "scan_estimates_ip_mean": _close(_E + _pq("ip", centred=True) + _est("ip", centred=True), _EST_OUT),
    "index_insert": _close(_E + _IVF, 'SELECT id AS vec_id, logical_id, list_no, off AS "offset" FROM place'),
    "index_erase": _close(_E + _IVF + _MOVES, 'SELECT id AS vec_id, place.list_no, coalesce(to_offset, off) AS "offset" FROM place LEFT JOIN moves ON moved_id = logical_id WHERE id % 20 <> 0'),
    "index_locate": _close(_E + _IVF + _MOVES, 'SELECT logical_id AS id, CASE WHEN id % 20 <> 0 THEN place.list_no END AS list_no, CASE WHEN id % 20 <> 0 THEN coalesce(to_offset, off) END AS "offset" FROM place LEFT JOIN moves ON moved_id = logical_id'),
    "index_erase_pages": _close(_E + _IVF + _MOVES, f""", tail_page AS (SELECT list_no, n // {_PER_PAGE} AS page FROM left_ WHERE n % {_PER_PAGE} <> 0 AND gone > 0),
        written AS (SELECT list_no, to_offset // {_PER_PAGE} AS page FROM moves UNION SELECT * FROM tail_page),
        seen AS (SELECT * FROM written UNION SELECT list_no, from_offset // {_PER_PAGE} FROM moves UNION SELECT list_no, off // {_PER_PAGE} FROM place WHERE id % 20 = 0)
        SELECT list_no, gone AS deleted, (SELECT count(*) FROM moves m WHERE m.list_no = l.list_no) AS moved, (SELECT count(*) FROM seen s WHERE s.list_no = l.list_no) AS pages_read,
               (SELECT count(*) FROM written w WHERE w.list_no = l.list_no) AS pages_written FROM left_ l WHERE gone > 0"""),
    "index_reload": _close(_E + _IVF + _pq(), f"""SELECT id AS vec_id, list_no, off AS "offset", off // {_PER_PAGE} AS page_no, {_HEX} AS code, norm_c, scale_c, err_c FROM enc JOIN place USING (id)"""),
}
