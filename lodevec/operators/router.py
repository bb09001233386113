"""The coarse router: centroids, the list of each vector and the lists that a query probes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodevec.operators.quantizer import kmeans, matrix, training_rows
from lodevec.plans.config import IndexConfig, need


def train_centroids(vectors: DataFrame, config: IndexConfig) -> np.ndarray:
    """nlist centroids by squared L2 whatever the metric, from a bounded sample. With router pq4 each coordinate is put
    on one of 16 levels learned for its dimension."""
    rows = training_rows(vectors, config)
    need(len(rows) >= config.nlist, f"at least {config.nlist} vectors are needed")
    centroids = rows[: config.nlist].copy() if config.init == "first_rows" else kmeans(rows, config.nlist, config.seed)
    if config.router == "pq4":
        for d in range(config.dimension):
            levels = kmeans(centroids[:, d : d + 1], 16, config.seed + d)[:, 0]
            centroids[:, d] = levels[np.abs(centroids[:, d, None] - levels).argmin(1)]
    return centroids


def to_centroids(x: np.ndarray, centroids: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """Squared distances, rows x lists, summed in index order; rows at a time such that there are about so many cells."""
    out, rows = np.zeros((len(x), len(centroids))), max(1, cells // max(1, len(centroids)))
    for at in range(0, len(x), rows):
        for d in range(x.shape[1]):
            gap = x[at : at + rows, d, None] - centroids[None, :, d]
            gap *= gap
            out[at : at + rows] += gap
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (with embedding) and list_no, the nearest list (ties: the smaller number)."""
    place = vectors.columns.index("embedding")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", list_no int"

    def run(batches):
        for batch in batches:
            step = max(1, (1 << 22) // len(centroids))  # a few rows at a time, so memory doesn't grow with rows x lists
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                near = to_centroids(matrix(part.column(place), centroids.shape[1]), centroids).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "list_no"])

    return vectors.mapInArrow(run, schema)


def nearest_lists(q: np.ndarray, centroids: np.ndarray, nprobe: int) -> np.ndarray:
    """Lists by (distance, number), at most nlist."""
    return np.argsort(to_centroids(q, centroids), axis=1, kind="stable")[:, : min(nprobe, len(centroids))]


def route(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """(qid, probe_rank, list_no) of queries (qid, qv); ranks from 1."""
    need(nprobe > 0, "nprobe must be positive")

    def run(batches):
        for batch in batches:
            lists = nearest_lists(matrix(batch.column(1), centroids.shape[1]), centroids, nprobe)
            n, k = lists.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(lists.ravel().astype(np.int32))], ["qid", "probe_rank", "list_no"])

    return queries.select("qid", "qv").mapInArrow(run, "qid long, probe_rank int, list_no int")
