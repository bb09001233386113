"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed byte n-gram of the lower-cased text, white space counting as one kind of space.
Its value is its log-count ratio between toxic and other labelled texts; a logistic regression on these values gives the
weights. Weights are whole numbers (fixed point), so a score doesn't depend on how rows are batched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import buffers, drop_paths, gram_codes, hashed_sample, text_bytes, tidy, written


@dataclass(frozen=True)
class ToxicParams:
    """orders: lengths of the n-grams in bytes; bits: of their hash, for each order; smooth: pseudo-count of the ratios;
    max_rows: most labelled texts that the model is fitted on (those with the smallest hashed ids); features: buckets
    with the largest weight of evidence that the regression uses; l2, steps: of the regression; least: score from which
    a text is called toxic; fold, folds: rows whose crc32 leaves this remainder are never learned from."""

    orders: tuple[int, ...] = (5, 8, 11)
    bits: int = 18
    smooth: float = 1.0
    max_rows: int = 12_000
    features: int = 1_536
    least_support: int = 5
    l2: float = 1e-4
    steps: int = 300
    least: float = 0.7
    fold: int = 1
    folds: int = 3
    scale: int = 1 << 16


#: Lower-cases A-Z and makes every ASCII white-space character a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32


def held_out(doc_id: Column, p: ToxicParams) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % p.folds == p.fold, F.lit(False))


@dataclass(frozen=True)
class ToxicModel:
    """slot[k][bucket]: the feature's place plus one, 0 for none; weights: fixed point, by place; bias: fixed point."""

    params: ToxicParams
    slot: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    bias: int = 0

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, feature) of a byte buffer, each once."""
        folded, keys = FOLD[data], []
        for k, order in enumerate(self.params.orders):
            place = self.slot[k][gram_codes(folded, order, self.params.bits, k)]
            at = np.flatnonzero(place)
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + order <= offsets[row + 1]
            keys.append((row[inside].astype(np.int64) << 32) + place[at[inside]] - 1)
        both = np.unique(np.concatenate(keys))
        return both >> 32, both & 0xFFFFFFFF

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, feature = self.found(data, offsets)
        total = np.full(len(offsets) - 1, self.bias, np.int64)
        np.add.at(total, row, self.weights[feature])
        return 1 / (1 + np.exp(-np.clip(total / self.params.scale, -500, 500)))


def labelled(docs: DataFrame, labels: DataFrame, p: ToxicParams) -> DataFrame:
    """(text bytes, toxic) of at most max_rows labelled rows outside the held-out fold; the ids' side is broadcast."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), "toxic").where(~held_out(F.col("_id"), p))
    known = hashed_sample(known.groupBy("_id").agg(F.max("toxic").alias("toxic")), "_id", p.max_rows)
    return docs.select("doc_id", text_bytes("text").alias("_text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("_text", "toxic")


def ratios(sample: DataFrame, p: ToxicParams, paths: list[str]) -> DataFrame:
    """(k, bucket, pos, neg, ratio, evidence) of every bucket with enough support: numbers of toxic and of other texts of
    sample (text bytes, toxic) that have it, and its log-count ratio."""
    size = 1 << p.bits

    def count(batches):
        counts = np.zeros((2, len(p.orders), size), np.int32)
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for first, data, offsets in buffers(batch.column(0)):
                folded = FOLD[data]
                for i in range(len(offsets) - 1):
                    for k, order in enumerate(p.orders):
                        counts[toxic[first + i], k][np.unique(gram_codes(folded[offsets[i] : offsets[i + 1]], order, p.bits, k))] += 1
        k, bucket = np.nonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[1, k, bucket]), pa.array(counts[0, k, bucket])], ["k", "bucket", "pos", "neg"])

    rows = sample.mapInArrow(tidy(count), "k int, bucket int, pos int, neg int").groupBy("k", "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = written(rows.where(F.col("pos") + F.col("neg") >= p.least_support), "grams", paths)
    pos, neg = F.col("pos") + p.smooth, F.col("neg") + p.smooth
    all_pos, all_neg = rows.agg(F.sum(pos), F.sum(neg)).first()
    rows = rows.withColumn("ratio", F.log(pos / (all_pos or 1.0)) - F.log(neg / (all_neg or 1.0)))
    return rows.withColumn("evidence", (F.col("pos") + F.col("neg")) * F.col("ratio") * F.col("ratio"))


def fit(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> ToxicModel:
    """Log-count ratios over the hash space, then the regression on the chosen features of the bounded sample. The driver
    gets a row for each feature and, of each sampled text, which features it has."""
    p, paths = params, []
    sample = labelled(docs, labels, p)
    best = ratios(sample, p, paths).orderBy(F.desc("evidence"), "k", "bucket").limit(p.features).select("k", "bucket", "ratio").toArrow()
    drop_paths(docs.sparkSession, paths)
    k, bucket, ratio = (best.column(i).to_numpy() for i in range(3))
    order = np.lexsort((bucket, k))
    slot = np.zeros((len(p.orders), 1 << p.bits), np.int32)
    slot[k[order], bucket[order]] = np.arange(len(order)) + 1
    bare = ToxicModel(p, slot, np.zeros(len(order), np.int64))

    def gather(batches):
        for batch in batches:
            lists = []
            for _, data, offsets in buffers(batch.column(0)):
                row, feature = bare.found(data, offsets)
                lists += [x.tobytes() for x in np.split(feature.astype(np.int16), np.searchsorted(row, np.arange(1, len(offsets) - 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(lists, pa.binary())], ["toxic", "found"])

    drawn = sample.mapInArrow(tidy(gather), "toxic int, found binary").toArrow()
    # In an order that doesn't depend on partitions, so that sums don't either.
    rows = sorted(zip(drawn.column(0).to_pylist(), drawn.column(1).to_pylist()))
    if not len(rows) or not len(order):
        return bare
    scaled = ratio[order].astype(np.float32)
    x = np.zeros((len(rows), len(order)), np.float32)
    for i, (_, found) in enumerate(rows):
        at = np.frombuffer(found, np.int16)
        x[i, at] = scaled[at]
    weights, bias = regression(x, np.array([t for t, _ in rows], np.float32), p)
    return ToxicModel(p, slot, np.rint(weights * scaled * p.scale).astype(np.int64), round(bias * p.scale))


def regression(x: np.ndarray, y: np.ndarray, p: ToxicParams) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge penalty, by accelerated gradient steps of a safe length."""
    n, m = x.shape
    v = np.ones(m, np.float32)
    for _ in range(20):  # largest eigenvalue of x'x / n
        v = x.T @ (x @ v)
        v /= max(np.linalg.norm(v), 1e-30)
    rate = 1 / (0.25 * (np.linalg.norm(x @ v) ** 2 / n + 1) + p.l2)
    w, b, w0, b0 = np.zeros(m, np.float32), 0.0, np.zeros(m, np.float32), 0.0
    for t in range(1, p.steps + 1):
        q = (t - 1) / (t + 2)
        wy, by = w + q * (w - w0), b + q * (b - b0)
        gap = 1 / (1 + np.exp(-np.clip(x @ wy + by, -60, 60))) - y
        w0, b0 = w, b
        w, b = (wy - rate * (x.T @ gap / n + p.l2 * wy)).astype(np.float32), float(by - rate * gap.mean())
    return w, b


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text).

    The score looks at the text alone. Null and empty texts get the score of a text without features. A null doc_id is
    not held out. Without labels, or with labels of one kind, nothing is learned and scores don't depend on the text.
    Rows are scored one by one; repeated rows stay.
    """
    model = fit(docs, labels, params)

    def rate(batches):
        for batch in batches:
            scores = [model.scores(data, offsets) for _, data, offsets in buffers(batch.column(2))]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= params.least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), params).alias("held_out"), text_bytes("text").alias("_text"))
    return rows.mapInArrow(tidy(rate), "doc_id long, held_out boolean, score double, predicted int")
