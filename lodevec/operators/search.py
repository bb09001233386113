"""Batched search: scan of codes, interval selection, exact refinement; and exact search without an index.

All queries of a block are answered in one pass. A task keeps, for each query, only what can still matter after it: its
smallest upper ends and its smallest estimates, so a scan of any size returns queries x (k + limit) rows a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodevec.functions.vectors import distance, lower, upper
from lodevec.operators.quantizer import Quantizer, code_matrix, matrix, squares
from lodevec.plans.config import SearchParams, need


@dataclass(frozen=True)
class QueryBlock:
    """Up to query_block queries on the driver."""

    qid: np.ndarray
    qv: np.ndarray


def query_blocks(queries: DataFrame, dimension: int, size: int):
    """The queries in blocks of bounded size, by id; one block at a time is on the driver."""
    last = None
    while True:
        rows = (queries if last is None else queries.where(F.col("qid") > last)).select("qid", "qv").orderBy("qid").limit(size).toArrow()
        if not rows.num_rows:
            return
        block = QueryBlock(rows.column("qid").to_numpy(), matrix(rows.column("qv").combine_chunks(), dimension))
        need(len(np.unique(block.qid)) == len(block.qid), "query ids must be unique")
        yield block
        last = int(block.qid[-1])


def exact_distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "l2":
        return squares(x - q)
    dots = np.zeros(len(x))
    for d in range(x.shape[1]):
        dots += q[d] * x[:, d]
    if metric == "ip":
        return -dots
    size = np.sqrt(squares(q[None]))[0] * np.sqrt(squares(x))
    return np.where(size == 0, 1.0, np.maximum(0.0, 1.0 - dots / np.where(size == 0, 1.0, size)))


def smallest(value: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest by (value, tie)."""
    if len(value) > 4 * k:
        edge = np.partition(value, k - 1)[k - 1]
        near = np.flatnonzero(value <= edge)
    else:
        near = np.arange(len(value))
    return near[np.lexsort((tie[near], value[near]))[:k]]


def top(rows: DataFrame, k: int, by: str = "distance", tie: str = "id") -> DataFrame:
    """The k smallest rows of each query with their rank from 1."""
    order = W.partitionBy("qid").orderBy(by, tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rough_distances(metric: str, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances, queries x rows, as one matrix product, and how far each query's may be off."""
    dots, size = q @ x.T, np.sqrt((x * x).sum(1))
    length = np.sqrt((q * q).sum(1))
    if metric == "cosine":
        return np.where((length[:, None] == 0) | (size == 0), 1.0, 1.0 - dots / np.maximum(length[:, None] * size, 1e-300)), np.full(len(q), 1e-9)
    off = 1e-12 * (1.0 + (length + size.max(initial=0.0)) ** 2)
    return (-dots, off) if metric == "ip" else (length[:, None] ** 2 - 2 * dots + size**2, off)


def exact_knn(vectors: DataFrame, queries: DataFrame, dimension: int, k: int = 10, metric: str = "l2", block: int = 2_048) -> DataFrame:
    """(qid, rank, id, distance): the k nearest rows of vectors (id, embedding) for each query (qid, qv), all rows seen.

    A matrix product finds the rows that can be among the k nearest; only those are measured exactly.
    """
    out = None
    for b in query_blocks(queries, dimension, block):

        def run(batches, b=b):
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for at in range(0, len(batch), 1_000):
                    part = batch.slice(at, 1_000)
                    ids, x = part.column(0).to_numpy(), matrix(part.column(1), dimension)
                    rough, off = rough_distances(metric, b.qv, x)
                    edge = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1] + 2 * off
                    for i in range(len(b.qid)):
                        # A row beyond the k-th best of the rows before it can't be among the k nearest either.
                        most = min(edge[i], best[i][0].max() + 2 * off[i]) if i in best and len(best[i][0]) >= k else edge[i]
                        near = np.flatnonzero(rough[i] <= most)
                        if len(near):
                            d, own = exact_distances(metric, b.qv[i], x[near]), ids[near]
                            if i in best:
                                d, own = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], own])
                            keep = smallest(d, own, k)
                            best[i] = d[keep], own[keep]
            if best:
                n = [len(best[i][0]) for i in best]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.qid[list(best)], n)), pa.array(np.concatenate([v[1] for v in best.values()])), pa.array(np.concatenate([v[0] for v in best.values()]))], ["qid", "id", "distance"])

        part = vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(run, "qid long, id long, distance double")
        out = part if out is None else out.union(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "qid long, rank int, id long, distance double")
    return top(out, k).select("qid", "rank", "id", "distance")


def probes_with_tokens(probes: DataFrame, sizes: DataFrame) -> DataFrame:
    """probes (qid, probe_rank, list_no) of lists that hold rows, with begin and end: the places of each list's rows in
    the query's own numbering, list after list in the order probed."""
    held = probes.join(sizes.where("size > 0"), "list_no")
    end = F.sum("size").over(W.partitionBy("qid").orderBy("probe_rank"))
    return held.withColumn("end", end).withColumn("begin", F.col("end") - F.col("size"))


def estimates(postings: DataFrame, model: Quantizer, block: QueryBlock, probes: dict[int, dict[int, int]], lut: str = "exact") -> DataFrame:
    """(qid, list_no, offset, token, est, unc) of all probed rows: for small inputs and tests; a search selects in the
    scan. probes: for each place of a query its lists, each with the token of its first row."""
    return _scan(postings, model, block, probes, None, lut=lut)


def _scan(postings: DataFrame, model: Quantizer, block: QueryBlock, probes: dict[int, dict[int, int]], params: SearchParams | None, theta: dict[int, float] | None = None, lut: str = "exact") -> DataFrame:
    """params: keep what may matter to a selection (None: all rows). theta: by query id, keep rows whose lower end is at
    most this instead."""
    query = model.query(block.qv)
    wanted: dict[int, list[tuple[int, int]]] = {}
    for i, lists in probes.items():
        for list_no, begin in lists.items():
            wanted.setdefault(list_no, []).append((i, begin))

    def run(batches):
        kept: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            lists, offsets = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            codes = code_matrix(batch.column(2), model.config)
            meta = model.decoded_metadata(*(batch.column(k).to_numpy().astype(np.float64) for k in (3, 4, 5)))
            for list_no in np.unique(lists):
                rows = np.flatnonzero(lists == list_no)
                own = codes[rows], [x[rows] for x in meta]
                for i, begin in wanted.get(int(list_no), ()):
                    est, unc = model.estimates(query, i, *own, params.lut if params else lut)
                    token = begin + offsets[rows]
                    found = np.rec.fromarrays([np.full(len(rows), block.qid[i]), lists[rows].astype(np.int32), offsets[rows], token, est, unc], names="qid,list_no,offset,token,est,unc")
                    if theta is not None:
                        found = found[_lower(est, unc, params.z) <= theta[int(block.qid[i])]]
                        if len(found):
                            yield _records(found)
                    elif params:
                        held = np.concatenate([kept.pop(i), found]) if i in kept else found
                        ends = _upper(held["est"], held["unc"], params.z)
                        keep = np.union1d(smallest(ends, held["token"], params.k), smallest(held["est"], held["token"], max(params.limit, 1)))
                        kept[i] = held[keep]
                    elif len(found):
                        yield _records(found)
        for found in kept.values():
            yield _records(found)

    return postings.select("list_no", "offset", "code", "norm_c", "scale_c", "err_c").mapInArrow(run, "qid long, list_no int, offset long, token long, est double, unc double")


def _upper(est: np.ndarray, unc: np.ndarray, z: float) -> np.ndarray:
    if z == 0:
        return np.where(np.isnan(est), np.inf, est)
    with np.errstate(invalid="ignore"):
        end = est + unc * z
    return np.where(unc == 0, est, np.where(np.isinf(unc) | np.isnan(end), np.inf, end))


def _lower(est: np.ndarray, unc: np.ndarray, z: float) -> np.ndarray:
    if z == 0:
        return np.where(np.isnan(est), -np.inf, est)
    with np.errstate(invalid="ignore"):
        end = est - unc * z
    return np.where(unc == 0, est, np.where(np.isinf(unc) | np.isnan(end), -np.inf, end))


def _records(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[n])) for n in found.dtype.names], list(found.dtype.names))


def interval_select(estimated: DataFrame, params: SearchParams, strict: bool = True) -> DataFrame:
    """Candidates among estimates (qid, token, est, unc, further columns), with rank by (est, token) and theta.

    theta is the k-th smallest upper end over all rows of the query; of the limit rows with the smallest (est, token)
    those stay whose lower end is at most theta. strict: a query with fewer than k rows fails.
    """
    p = params
    rows = estimated.withColumn("est", F.when(F.isnan("est"), float("inf")).otherwise(F.col("est")))
    rows = rows.withColumn("_upper", upper(F.col("est"), F.col("unc"), p.z))
    ranked = rows.withColumn("_place", F.row_number().over(W.partitionBy("qid").orderBy("_upper", "token"))).where(F.col("_place") <= p.k)
    theta = ranked.groupBy("qid").agg(F.max("_upper").alias("theta"), F.count(F.lit(1)).alias("_seen"))
    if strict:
        theta = theta.withColumn("theta", F.when(F.col("_seen") >= p.k, F.col("theta")).otherwise(F.raise_error(F.lit("fewer rows than k were scanned")).cast("double")))
    short = rows
    if p.limit:
        short = rows.withColumn("_place", F.row_number().over(W.partitionBy("qid").orderBy("est", "token"))).where(F.col("_place") <= p.limit).drop("_place")
    kept = short.join(theta.drop("_seen"), "qid").where(lower(F.col("est"), F.col("unc"), p.z) <= F.col("theta"))
    return kept.drop("_upper").withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("est", "token")))


def refine(candidates: DataFrame, records: DataFrame, queries: DataFrame, params: SearchParams, metric: str, exact=None) -> DataFrame:
    """(qid, rank, id, distance): candidates (qid, list_no, offset) by exact distance, then id. exact: an own function
    of the query's and the record's vector columns; distances must be finite, and not negative but for ip. A query with
    fewer than k candidates fails."""
    joined = candidates.select("qid", "list_no", "offset").join(records.select("list_no", "offset", "id", "payload"), ["list_no", "offset"]).join(queries.select("qid", "qv"), "qid")
    value: Column = exact(F.col("qv"), F.col("payload")) if exact else distance(metric, F.col("qv"), F.col("payload"))
    bad = F.isnan(value) | (F.abs(value) == float("inf")) | ((value < 0) if metric != "ip" else F.lit(False))
    checked = joined.select("qid", "id", F.when(bad, F.raise_error(F.lit("an exact distance is negative or not finite")).cast("double")).otherwise(value).alias("distance"))
    few = F.count(F.lit(1)).over(W.partitionBy("qid")) < params.k
    checked = checked.withColumn("distance", F.when(few, F.raise_error(F.lit("fewer candidates than k")).cast("double")).otherwise(F.col("distance")))
    return top(checked, params.k).select("qid", "rank", "id", "distance")


def read_plan(candidates: DataFrame, per_page: int) -> DataFrame:
    """(qid, pages, requests): distinct pages that hold a query's candidates, and runs of neighbouring pages."""
    pages = candidates.select("qid", "list_no", F.floor(F.col("offset") / per_page).alias("page")).distinct()
    before = F.lag("page").over(W.partitionBy("qid", "list_no").orderBy("page"))
    starts = pages.withColumn("new", F.when(before.isNull() | (F.col("page") != before + 1), 1).otherwise(0))
    return starts.groupBy("qid").agg(F.count(F.lit(1)).alias("pages"), F.sum("new").cast("long").alias("requests"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall): the share of the true (qid, id) among the k nearest that was found."""
    truth = truth.where(F.col("rank") <= k).select("qid", "id")
    hits = truth.join(found.where(F.col("rank") <= k).select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hits.agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))
