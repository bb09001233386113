"""Connected components by alternating large-star and small-star steps; each task contracts the edges it writes, and once
no more edges are left than one task contracts at once, one does."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import drop_paths, tidy, written


#: Edges that a task contracts at once.
RUN = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges other than roots, and the smallest node that each reaches by them."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for ends in (x, y, root[x], root[y]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges of the same components, fewer: what a task holds becomes stars."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            a, b = local_roots(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if len(batch):
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= RUN:
                yield flush()
        if held:
            yield flush()

    return edges.select("a", "b").mapInArrow(tidy(run), "a long, b long")


def _star(edges: DataFrame) -> DataFrame:
    """Large star: every node's larger neighbours are linked to its smallest neighbour (itself included)."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Small star: every node and its smaller neighbours are linked to the smallest of them. Edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, paths: list[str], run: int = RUN) -> DataFrame:
    """(id, component): each linked node with the smallest node it reaches. links: two columns of longs, any order,
    repeats and loops allowed; nodes without a link get no row. paths gets the folder of the result.

    A step moves a bounded number of rows per link; hubs meet in map-side combines and in joins that AQE can split. run:
    edges that one task contracts; where the steps have left no more, one task ends the work.
    """
    x, y = links.columns
    pairs = links.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    spark, own, old = links.sparkSession, [], []
    edges, mark = written(contracted(pairs), "edges", own), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, few, new_paths = now, now[0] <= run, []
        # Stars come out with the root as b, and no node other than a root is in two of them.
        step = contracted(edges.coalesce(1)) if few else contracted(_small_star(_star(edges))).distinct()
        edges = written(step, "edges", new_paths)
        drop_paths(spark, old)
        old, own = own, new_paths
        if few:
            break
    drop_paths(spark, old)
    paths += own
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
