"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus, beside plain base rules.

The target multinomial comes from trusted documents (labelled of good quality), the raw one from every document of the
corpus. A document's score is the sum over its hashed byte n-grams of log(p_target / p_raw), divided by their number.
Weights are whole numbers (fixed point), so a sum doesn't depend on the order in which it is formed and reruns agree.
The threshold is learned from labelled documents: with a target that a fold of the trusted ones is spared from, it is
where that fold's and bad documents' scores are told apart best, halfway across the gap. The target is then taken from all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodevec.llm.common import buffers, drop_paths, gram_codes, mixed, sums_by_row, text_bytes, tidy, written
from lodevec.llm.exact_dedup import filter_bits, hit_filter, with_mark

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class QualityParams:
    """Production parameters.

    orders, bits: lengths of the byte n-grams and bits of their hash; smooth: pseudo-count of each bucket;
    threshold: least score of a document that stays (nats per n-gram) where no labels tell; steps: parts of a nat between
    which the threshold is searched; lost: how many bad documents kept are as bad as a good one lost;
    fold, folds: documents labelled good whose crc32 leaves this remainder are spared while the threshold is learned; min_words, max_repeat_pct:
    the base rules; scale: fixed-point unit of a weight.
    """

    orders: tuple[int, ...] = (2, 3)
    bits: int = 16
    smooth: float = 2.0
    threshold: float = -0.5
    steps: int = 8_192
    lost: float = 4.0
    fold: int = 1
    folds: int = 3
    min_words: int = 50
    max_repeat_pct: int = 50
    scale: int = 1 << 20


@dataclass(frozen=True)
class QualityModel:
    """weights[i]: fixed-point log ratio of each bucket for n-grams of orders[i]; threshold: least score that stays."""

    params: QualityParams
    weights: np.ndarray = field(repr=False)
    threshold: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights and numbers of n-grams of each row of a byte buffer, exact."""
        total, n = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
        for k, order in enumerate(self.params.orders):
            total += sums_by_row(self.weights[k][gram_codes(data, order, self.params.bits, k)], offsets, order)
            n += np.clip(np.diff(offsets) - order + 1, 0, None)
        return total, n


def spared(doc_id: str, p: QualityParams) -> Column:
    """Whether a document is of the fold that the threshold is learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % p.folds == p.fold


def labelled(docs: DataFrame, ids: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, ...) that are none of ids (_id, ...), and the others beside the columns of their ids' rows, null
    where they are none either. A filter of bounded size keeps the first where they are; only the others meet their ids."""
    bits = filter_bits(ids.count())
    ids = ids.withColumn("_id", F.col("_id").try_cast(docs.schema["doc_id"].dataType))  # equal numbers of other types hash otherwise
    marked = with_mark(docs, "doc_id", written(hit_filter(ids.select(F.col("_id").alias("digest")), bits), "filter", paths), bits)
    return marked.where("not _maybe").drop("_maybe"), marked.where("_maybe").drop("_maybe").join(ids, F.col("doc_id") == F.col("_id"), "left")


def trusted_ids(labels: DataFrame, params: QualityParams, paths: list[str]) -> DataFrame:
    """(_id, _spared) of every document labelled of good quality."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    return written(good.withColumn("_spared", spared("_id", params).cast("int")), "trusted", paths)


def split_at(low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray, p: QualityParams) -> float:
    """The middle of the widest gap between steps of scores where shares of good ones lost and bad ones kept cost least.
    For each step, ascending: its lowest and highest score, and how many good and bad ones it holds."""
    if len(low) < 2 or not good.sum() or not bad.sum():
        return p.threshold
    cost = p.lost * np.cumsum(good)[:-1] / good.sum() + 1 - np.cumsum(bad)[:-1] / bad.sum()
    fit = np.flatnonzero(cost <= cost.min() + 1e-12)
    best = fit[np.argmax((low[1:] - high[:-1])[fit])]
    return float((high[best] + low[best + 1]) / 2)


def best_threshold(good: np.ndarray, bad: np.ndarray, p: QualityParams) -> float:
    """split_at of some scores."""
    at, place = np.unique(np.concatenate([good, bad]), return_inverse=True)
    return split_at(at, at, *(np.bincount(x, minlength=len(at)) for x in (place[: len(good)], place[len(good) :])), p)


def learned_threshold(docs: DataFrame, labels: DataFrame, model: QualityModel, paths: list[str]) -> float:
    """From all documents that the base rules let through, good ones of the spared fold and bad ones. Scores are bounded,
    and so are their steps: the driver gets a row for each."""
    p = model.params
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where((F.col("quality") == 0) | spared("doc_id", p)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    _, mine = labelled(docs.select("doc_id", "text"), written(known, "known", paths), paths)
    scores = score(mine.where("_quality is not null").select("_quality", "text"), model, keep=["_quality"]).where("not base_failed")
    count = lambda q: F.sum((F.col("_quality") == q).cast("long"))
    steps = scores.groupBy(F.floor(F.col("llr") * p.steps).alias("step")).agg(F.min("llr").alias("low"), F.max("llr").alias("high"), count(1).alias("good"), count(0).alias("bad")).toPandas().sort_values("step")
    return split_at(*(steps[c].to_numpy() for c in ("low", "high", "good", "bad")), p)


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Count hashed n-grams of all documents and of all trusted ones; what reaches the driver is one row for each bucket."""
    paths: list[str] = []
    others, mine = labelled(docs.select("doc_id", text_bytes("text").alias("_text")), trusted_ids(labels, params, paths), paths)
    marked = others.select("_text", F.lit(-1).alias("_good")).unionByName(mine.select("_text", F.coalesce("_spared", F.lit(-1)).alias("_good")))
    size = 1 << params.bits

    def count(batches):
        raw = np.zeros((len(params.orders), size), np.int64)
        target = np.zeros((2, *raw.shape), np.int64)  # spared or not
        for batch in batches:
            trusted = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in buffers(batch.column(0)):
                mine = trusted[first : first + len(offsets) - 1]
                for k, order in enumerate(params.orders):
                    codes = gram_codes(data, order, params.bits, k)
                    for lo, hi, good in zip(offsets[:-1], offsets[1:], mine):
                        if good >= 0 and hi - lo >= order:
                            target[good, k] += np.bincount(codes[lo : hi - order + 1], minlength=size)
                    inside = np.ones(len(codes), bool)
                    for back in range(1, order):  # n-grams that begin in one row and end in another
                        edge = offsets[1:-1] - back
                        inside[edge[(edge >= 0) & (edge < len(inside))]] = False
                    raw[k] += np.bincount(codes[inside], minlength=size)
        k, bucket = np.nonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(raw[k, bucket]), pa.array(target[0, k, bucket]), pa.array(target[1, k, bucket])], ["k", "bucket", "raw", "target", "spared"])

    parts = marked.mapInArrow(tidy(count), "k int, bucket int, raw long, target long, spared long")
    rows = parts.groupBy("k", "bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "target", "spared"))).toPandas()

    def weights(number) -> np.ndarray:
        raw, target = np.full((len(params.orders), size), params.smooth), np.full((len(params.orders), size), params.smooth)
        raw[rows.k, rows.bucket] += rows.raw
        target[rows.k, rows.bucket] += number
        ratio = np.log(target / target.sum(1, keepdims=True)) - np.log(raw / raw.sum(1, keepdims=True))
        if not number.sum():
            ratio[:] = 0  # nothing trusted: no document is turned down by the ratio
        return np.rint(ratio * params.scale).astype(np.int32)

    model = QualityModel(params, weights(rows.target), params.threshold)
    learned = learned_threshold(docs, labels, model, paths) if rows.target.sum() else params.threshold
    drop_paths(docs.sparkSession, paths)
    return QualityModel(params, weights(rows.target + rows.spared), learned)


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    if not data:
        return 0, 0, 0, 0, 0
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(data) - int(seen[list(SPACES)].sum()) - int(seen[0x80:0xC0].sum())
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)] if seen[10] else []
    words = data.split()
    repeated = 0
    if len(words) > 3:
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        grams = mixed(h[:-2] * np.uint64(3) ^ mixed(h[1:-1] * np.uint64(5) ^ mixed(h[2:])))
        ranked = np.sort(grams)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(twice):
            at = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
            found = twice[at] == grams
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : len(words) - 2 + k] |= found
            repeated = int(covered.sum())
    return len(words), chars, int(seen[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated


def score(docs: DataFrame, model: QualityModel, keep: list[str] = ["doc_id"]) -> DataFrame:
    """Every document's counts, score and verdict beside the columns in keep.

    Null text counts as empty: no words, so the base rules turn it down. Texts without an n-gram score 0. Rows are
    judged one by one: repeated rows stay, a null doc_id stays, other columns are not looked at.
    """
    p = model.params
    fields = docs.select(*keep).schema

    def rate(batches):
        for batch in batches:
            column = batch.column(len(keep))
            total, n = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            for first, data, offsets in buffers(column):
                last = first + len(offsets) - 1
                total[first:last], n[first:last] = model.scores(data, offsets)
            counts = np.array([base_counts(x) for x in column.to_pylist()], np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < p.min_words) | (100 * counts[:, 4] > p.max_repeat_pct * counts[:, 0])
            good = total >= np.rint(model.threshold * p.scale) * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *(pa.array(x) for x in counts.T.copy()), pa.array(failed), pa.array(total / np.maximum(n, 1) / p.scale), pa.array(~failed & good)],
                names=[f"c{i}" for i in range(len(keep) + 8)],
            )

    names = [f"k{i}" for i in range(len(keep))]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, fields)] + StructType.fromDDL(f"{COUNTS}, base_failed boolean, llr double, kept boolean").fields)
    # Column names in the plan are our own, so odd names in keep do no harm.
    out = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), text_bytes("text").alias("_text")).mapInArrow(tidy(rate), schema)
    return out.toDF(*keep, *out.columns[len(keep) :])


def quality_rules(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept of every row of docs (doc_id, text)."""
    return score(docs, fit(docs, labels, params))
