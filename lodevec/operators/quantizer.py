"""A 4-bit product quantizer of directions with three metadata bytes, and its training.

The model is a few small arrays on the driver; vectors stay in DataFrames and are encoded in Arrow batches. Sums run in
index order in double precision, as the SQL functions in lodevec.functions.vectors do.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.plans.config import IndexConfig, need
from lodevec.plans.grouping import bit_budgets, layout

TINY = 1e-12
CODES = 16


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles; every row must have the dimension and no nulls."""
    need(column.null_count == 0, "null vector")
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    need(flat.null_count == 0 and bool((lengths == dimension).all()), f"vectors must have {dimension} numbers and no nulls")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def squares(x: np.ndarray) -> np.ndarray:
    """Sums of squares over the last axis, in index order."""
    out = np.zeros(x.shape[:-1])
    for d in range(x.shape[-1]):
        out += x[..., d] * x[..., d]
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    for d in range(x.shape[-1]):
        out += x[..., d] * y[..., d]
    return out


def linear_code(value: np.ndarray, most: float, step: float) -> np.ndarray:
    if most <= 0:
        base = np.zeros(len(value))
    else:
        base = np.clip(np.floor(np.where(np.isfinite(value), value, 0) / step + 0.5), 0, 254)
    return np.where(~np.isfinite(value) | (value > most + 0.5 * step), 255, base).astype(np.int16)


def error_code(error: np.ndarray) -> np.ndarray:
    return np.ceil(np.clip(error, 0.0, 2.0) * 127.5 - 1e-7).astype(np.int16)


def kmeans(x: np.ndarray, k: int, seed: int, steps: int = 20) -> np.ndarray:
    """Lloyd's algorithm from k distinct seeded rows; an empty cell takes the row farthest from its centroid."""
    draw = np.random.default_rng(seed)
    centroids = x[draw.permutation(len(x))[:k]].astype(np.float64)
    if len(centroids) < k:
        centroids = np.concatenate([centroids, np.repeat(centroids[-1:], k - len(centroids), 0)])
    step = max(1, (1 << 22) // max(k, 1))  # rows at a time, so that memory doesn't grow with rows x k
    for _ in range(steps):
        cell, least = np.zeros(len(x), np.int64), np.zeros(len(x))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            gap = (part * part).sum(1)[:, None] - 2 * part @ centroids.T + (centroids * centroids).sum(1)
            cell[at : at + step] = near = gap.argmin(1)
            least[at : at + step] = gap[np.arange(len(part)), near]
        counts = np.bincount(cell, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        far = np.argsort(-least, kind="stable")
        for i, empty in enumerate(np.flatnonzero(counts == 0)[: len(far)]):
            new[empty] = x[far[i]]
        if np.allclose(new, centroids):
            break
        centroids = new
    return centroids


@dataclass
class Quantizer:
    """mean: subtracted first; rotation: applied to unit directions, or None; dims: of each group; codebooks: 16 rows
    for each group; norm_max, scale_max: ranges of the metadata."""

    config: IndexConfig
    mean: np.ndarray
    rotation: np.ndarray | None
    dims: list[np.ndarray]
    codebooks: list[np.ndarray] = field(repr=False)
    norm_max: float = 0.0
    scale_max: float = 0.0

    @property
    def norm_step(self) -> float:
        return self.norm_max / 254 if self.norm_max > 0 else 1.0

    @property
    def scale_step(self) -> float:
        return self.scale_max / 254 if self.scale_max > 0 else 1.0

    def directions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms of the centred rows and their rotated unit directions; the direction of a zero row is zero."""
        centred = x - self.mean
        norm = np.sqrt(squares(centred))
        zero = norm <= TINY
        unit = np.where(zero[:, None], 0.0, centred / np.where(zero, 1.0, norm)[:, None])
        return np.where(zero, 0.0, norm), unit @ self.rotation.T if self.rotation is not None else unit

    def codes_of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword of each group (ties: the smaller code) and what the codes stand for."""
        codes, recon = np.empty((len(unit), len(self.dims)), np.uint8), np.empty_like(unit)
        for m, (dims, book) in enumerate(zip(self.dims, self.codebooks)):
            codes[:, m] = squares(unit[:, None, dims] - book[None]).argmin(1)
            recon[:, dims] = book[codes[:, m]]
        return codes, recon

    def raw_metadata(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, norms, scales (not a number where the code stands for nothing) and errors."""
        norm, unit = self.directions(x)
        codes, recon = self.codes_of(unit)
        length = np.sqrt(squares(recon))
        cosine = self.config.metric == "cosine"
        lost = (length <= TINY) | (cosine & (norm <= TINY))
        safe = np.where(lost, 1.0, length)
        scale = np.where(lost, np.nan, (1.0 if cosine else norm) / safe)
        return codes, norm, scale, np.where(lost, 2.0, np.sqrt(squares(unit - recon / safe[:, None])))

    def encode_array(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        codes, norm, scale, error = self.raw_metadata(x)
        err = np.where(np.isnan(scale), 255, error_code(error)).astype(np.int16)
        return codes, linear_code(norm, self.norm_max, self.norm_step), linear_code(scale, self.scale_max, self.scale_step), err

    def decoded_metadata(self, norm_c: np.ndarray, scale_c: np.ndarray, err_c: np.ndarray):
        """Norms, scales, errors, and where the uncertainty is unbounded."""
        norm = np.where(norm_c == 255, self.norm_max, norm_c * self.norm_step)
        scale = np.where(scale_c == 255, self.scale_max, scale_c * self.scale_step)
        return norm, scale, err_c * 2.0 / 255.0, (scale_c == 255) | ((norm_c == 255) & (self.config.metric != "cosine"))

    def decode_array(self, codes: np.ndarray, norm_c: np.ndarray, scale_c: np.ndarray, err_c: np.ndarray) -> np.ndarray:
        """Approximate vectors."""
        recon = np.empty((len(codes), self.config.dimension))
        for m, (dims, book) in enumerate(zip(self.dims, self.codebooks)):
            recon[:, dims] = book[codes[:, m]]
        norm, scale, _, _ = self.decoded_metadata(norm_c, scale_c, err_c)
        out = recon * ((norm * scale) if self.config.metric == "cosine" else scale)[:, None]
        return (out @ self.rotation if self.rotation is not None else out) + self.mean

    def query(self, q: np.ndarray) -> dict[str, np.ndarray]:
        """Per query: norm, dot with the mean (inner product only) and the table of dot products, groups x 16."""
        c = self.config
        if c.metric == "cosine":
            length = np.sqrt(squares(q))
            need(bool((length > 0).all()), "a cosine query must not be zero")
            base, size = q / length[:, None], np.ones(len(q))
        else:
            base = q - self.mean if c.metric == "l2" else q
            size = np.sqrt(squares(base))
        turned = base @ self.rotation.T if self.rotation is not None else base
        table = np.stack([products(turned[:, None, dims], book[None]) for dims, book in zip(self.dims, self.codebooks)], 1)
        offset = products(q, self.mean) if c.metric == "ip" and c.centering == "mean" else np.zeros(len(q))
        return {"norm": size, "offset": offset, "table": table}

    def distance_table(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of each query's parts to the codewords, queries x groups x 16."""
        turned = q @ self.rotation.T if self.rotation is not None else q
        return np.stack([squares(turned[:, None, dims] - book[None]) for dims, book in zip(self.dims, self.codebooks)], 1)

    def estimates(self, query: dict[str, np.ndarray], i: int, codes: np.ndarray, metadata, lut: str = "exact") -> tuple[np.ndarray, np.ndarray]:
        """Estimated distances to query i, and uncertainties: a statistical scale, not a bound. lut uint8: the table of
        dot products is rounded to bytes first, less each row's least value, on one scale for all rows."""
        norm, scale, error, open_ = metadata
        table, size = query["table"][i], query["norm"][i]
        least, span = table.min(1), float((table.max(1) - table.min(1)).max())
        if lut == "uint8" and span > 1e-20:
            table = np.floor((table - least[:, None]) * (255 / span) + 0.5) * (span / 255) + least[:, None]
        dot = np.zeros(len(codes))
        for m in range(codes.shape[1]):
            dot += table[m][codes[:, m]]
        root = np.sqrt(float(self.config.dimension))
        if self.config.metric == "l2":
            est, unc = size * size + norm * norm - 2.0 * scale * dot, 2.0 * norm * size * error / root
        elif self.config.metric == "ip":
            est, unc = -(query["offset"][i] + scale * dot), norm * size * error / root
        else:
            est, unc = 1.0 - scale * dot, error / root
        return np.where(np.isfinite(est), est, np.inf), np.where(open_, np.inf, unc)

    def to_json(self) -> str:
        """The model with a check sum."""
        body = {"config": self.config.to_dict(), "mean": self.mean.tolist(), "rotation": None if self.rotation is None else self.rotation.tolist(), "dims": [d.tolist() for d in self.dims], "codebooks": [b.tolist() for b in self.codebooks], "norm_max": self.norm_max, "scale_max": self.scale_max}
        text = json.dumps(body, sort_keys=True)
        return json.dumps({"sha256": hashlib.sha256(text.encode()).hexdigest(), "model": text})

    @staticmethod
    def from_json(text: str) -> Quantizer:
        try:
            outer = json.loads(text)
            body = json.loads(outer["model"])
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("not a saved quantizer") from e
        need(hashlib.sha256(outer["model"].encode()).hexdigest() == outer["sha256"], "the saved quantizer is damaged")
        config = IndexConfig(**body["config"])
        out = Quantizer(config, np.array(body["mean"]), None if body["rotation"] is None else np.array(body["rotation"]), [np.array(d, np.int64) for d in body["dims"]], [np.array(b).reshape(CODES, -1) for b in body["codebooks"]], body["norm_max"], body["scale_max"])
        need(len(out.mean) == config.dimension and len(out.dims) == config.groups == len(out.codebooks), "the saved quantizer has another shape")
        need(sorted(np.concatenate(out.dims)) == list(range(config.dimension)), "the saved groups aren't a partition of the dimensions")
        need(out.norm_max >= 0 and out.scale_max >= 0 and all(np.isfinite(b).all() for b in out.codebooks), "the saved quantizer holds bad numbers")
        return out


def moments(vectors: DataFrame, dimension: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (population) of all vectors. Tasks sum what they read; the driver gets the sums."""

    def sums(batches):
        out = np.zeros(1 + dimension + dimension * dimension)
        for batch in batches:
            x = matrix(batch.column(0), dimension)
            out[0] += len(x)
            out[1 : dimension + 1] += x.sum(0)
            out[dimension + 1 :] += (x.T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["place", "value"])

    got = vectors.select("embedding").mapInArrow(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").toPandas().value.to_numpy()
    need(len(got) > 0 and got[0] > 0, "no vectors to learn from")
    mean = got[1 : dimension + 1] / got[0]
    return int(got[0]), mean, got[dimension + 1 :].reshape(dimension, dimension) / got[0] - np.outer(mean, mean)


def training_rows(vectors: DataFrame, config: IndexConfig) -> np.ndarray:
    """The first max_train_rows vectors by hashed id (by id for first_rows), on the driver."""
    rows, order = vectors.select("id", "embedding"), [F.col("id")]
    if config.init == "kmeans":
        # Thinned first to about twice the number, so that what is ranked in one task is bounded.
        n, order = vectors.count(), [F.xxhash64("id"), F.col("id")]
        if n > 2 * config.max_train_rows:
            rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(2 * config.max_train_rows / n * (1 << 30)))
            order = [F.pmod(F.xxhash64("id"), F.lit(1 << 30)), F.col("id")]
    rows = rows.orderBy(*order).limit(config.max_train_rows).toArrow()
    column = rows.column("embedding").combine_chunks()
    return matrix(column, config.dimension)


def rotation_of(covariance: np.ndarray, config: IndexConfig) -> np.ndarray | None:
    """Rows are axes by falling variance; balanced_pca deals them to equal groups so that log variances are even."""
    if config.transform == "none":
        return None
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, axes = np.maximum(values[order], 0), axes[:, order].T
    if config.transform == "balanced_pca":
        need(config.dimension % config.groups == 0, "balanced_pca needs a dimension divisible by groups")
        logs = np.log(np.maximum(values, max(float(values.max()), TINY) * 1e-12))
        bins: list[list[int]] = [[] for _ in range(config.groups)]
        for axis in range(config.dimension):
            free = [b for b in range(config.groups) if len(bins[b]) < config.dimension // config.groups]
            bins[min(free, key=lambda b: (sum(logs[bins[b]]), b))].append(axis)
        axes = axes[np.concatenate(bins).astype(int)]
    need(np.allclose(axes @ axes.T, np.eye(config.dimension), atol=1e-8), "the rotation isn't orthonormal")
    return axes


def train(vectors: DataFrame, config: IndexConfig) -> Quantizer:
    """Learn a quantizer from (id, embedding). Mean, covariance and ranges come from all rows, codebooks from a bounded
    sample."""
    _, mean, covariance = moments(vectors, config.dimension)
    if config.centering == "none":
        covariance = covariance + np.outer(mean, mean)
        mean = np.zeros(config.dimension)
    model = Quantizer(config, mean, rotation_of(covariance, config), [], [])
    _, unit = model.directions(training_rows(vectors, config))
    if config.grouping == "uniform":
        model.dims = list(np.arange(config.dimension).reshape(config.groups, -1))
    else:
        model.dims = layout(unit.var(0), config.groups, config.max_group_dims)
    need(len(unit) >= CODES, f"at least {CODES} vectors are needed")
    for m, dims in enumerate(model.dims):
        model.codebooks.append(unit[:CODES, dims].copy() if config.init == "first_rows" else kmeans(unit[:, dims], CODES, config.seed + m))
    ranges = metadata_ranges(vectors, model).first()
    model.norm_max, model.scale_max = float(ranges.norm_max or 0.0), float(ranges.scale_max or 0.0)
    return model


def metadata_ranges(vectors: DataFrame, model: Quantizer) -> DataFrame:
    """(norm_max, scale_max) over all rows."""

    def run(batches):
        for batch in batches:
            _, norm, scale, _ = model.raw_metadata(matrix(batch.column(0), model.config.dimension))
            scale = scale[~np.isnan(scale)]
            yield pa.RecordBatch.from_arrays([pa.array([norm.max(initial=0.0)]), pa.array([scale.max(initial=0.0)])], ["norm_max", "scale_max"])

    return vectors.select("embedding").mapInArrow(run, "norm_max double, scale_max double").agg(F.max("norm_max").alias("norm_max"), F.max("scale_max").alias("scale_max"))


def layout_frame(vectors: DataFrame, model: Quantizer) -> DataFrame:
    """(group, dimension, bits): the layout, with each dimension's share of bits by the variance of unit directions."""
    _, unit = model.directions(training_rows(vectors, model.config))
    bits = bit_budgets(unit.var(0), model.config.groups)
    rows = [(g, int(d), float(bits[d])) for g, dims in enumerate(model.dims) for d in dims]
    return vectors.sparkSession.createDataFrame(rows, "group int, dimension int, bits double")


def group_loads(vectors: DataFrame, model: Quantizer) -> DataFrame:
    """(group, dimensions, bits): the bits that each group's dimensions ask for; the aim is 4."""
    return layout_frame(vectors, model).groupBy("group").agg(F.count(F.lit(1)).alias("dimensions"), F.sum("bits").alias("bits"))


def buckets(model: Quantizer) -> list[dict[str, int]]:
    """Runs of groups of one width: dimensions of a group, groups, the first one and the first byte of its codes."""
    widths, out = [len(d) for d in model.dims], []
    for g, width in enumerate(widths):
        if g == 0 or width != widths[g - 1]:
            out.append({"dimensions": width, "groups": 0, "first_group": g, "code_offset": g // 2})
        out[-1]["groups"] += 1
    return out


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte: the even group in the low half."""
    return (codes[:, 0::2] | (codes[:, 1::2] << 4)).astype(np.uint8)


def unpacked(code: np.ndarray) -> np.ndarray:
    out = np.empty((len(code), code.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = code & 15, code >> 4
    return out


def code_matrix(column: pa.Array, config: IndexConfig) -> np.ndarray:
    return unpacked(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), config.code_bytes))


def encode(vectors: DataFrame, model: Quantizer) -> DataFrame:
    """vectors with code (binary, groups / 2 bytes), norm_c, scale_c and err_c; other columns stay."""
    names = vectors.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", code binary, norm_c smallint, scale_c smallint, err_c smallint"
    place = names.index("embedding")

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                codes, norm, scale, error = model.encode_array(matrix(part.column(place), model.config.dimension))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in packed(codes)], pa.binary()), pa.array(norm), pa.array(scale), pa.array(error)], [*names, "code", "norm_c", "scale_c", "err_c"])

    return vectors.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: Quantizer) -> DataFrame:
    """(id, embedding array<double>) from (id, code, norm_c, scale_c, err_c)."""

    def run(batches):
        for batch in batches:
            meta = [batch.column(k).to_numpy() for k in (2, 3, 4)]
            x = model.decode_array(code_matrix(batch.column(1), model.config), *meta)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "embedding"])

    return encoded.select("id", "code", "norm_c", "scale_c", "err_c").mapInArrow(run, "id long, embedding array<double>")
