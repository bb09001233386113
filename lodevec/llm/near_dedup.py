"""MinHash near-dedup with SetSketch registers.

A document's set holds its distinct word shingles. Register i of its sketch is the exponentially spaced, truncated
minimum floor(1 - log_b(min of Exp(a) hashes)), so sketches merge by maximum and agree more often the more alike two
sets are. Bands of registers are the buckets of a locality-sensitive index. A candidate pair's similarity is estimated
from how many registers are larger, smaller and equal, by maximum likelihood together with the two known set sizes;
pairs that may reach the threshold are confirmed on the full sets.

How the pairs of a bucket stay few: texts with equal sets count once; every member of a bucket is first tried against
the bucket's smallest id alone, and the links found are contracted to components. Only buckets that still hold several
components are searched again, for pairs between different components. Members of a bucket of up to a block's size meet
in one go. In wider ones many share a passage and little else: there two members meet only if a linked pair of their
sizes could still be one given their rarest shingles. Of a linked pair's shared shingles, in order of rarity, the first
is always among the rarest ones of both, so nothing is lost by this. What meets is compared in blocks of bounded size,
first by estimate, then on full sets. No bucket is expanded into all its pairs, and no candidate is dropped.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import drop_paths, mixed, text_bytes, tidy, written
from lodevec.llm.components import components
from lodevec.llm.exact_dedup import filter_bits, hit_filter, with_mark


@dataclass(frozen=True)
class NearParams:
    """words: length of a shingle; percent: least similarity of a link, in hundredths; bands x rows registers, at 75 %
    similarity a pair misses every band once in 400,000; base, rate, top: SetSketch's b, a and q + 1; slack: how far an
    estimate may fall short of the threshold (5.5 standard deviations); block: most members of a bucket that are
    compared with as many others in one go; salt: most pairs of one document that meet in one place; most_bits: bits of
    a filter at most (28: 32 MB), as an exponent; count_bits: slots in which shingles are counted at most (24: 32 MB),
    likewise."""

    words: int = 5
    percent: int = 75
    bands: int = 48
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    top: int = 65_535
    slack: float = 0.16
    block: int = 64
    salt: int = 64
    most_bits: int = 28
    count_bits: int = 24
    seed: int = 20_240

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(data: bytes, params: NearParams) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words the whole sequence is one."""
    words = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(params.words, len(words))
    n = len(words) - k + 1
    total = np.full(n, k * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for i in range(k):
        total = mixed(total + h[i : i + n])
    return np.unique(total)


class Sketcher:
    """Makes and compares sketches."""

    def __init__(self, params: NearParams):
        self.p = params
        draw = np.random.default_rng(params.seed)
        self.factors = draw.integers(0, 1 << 63, params.registers, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = draw.integers(0, 1 << 63, params.bands, np.uint64)

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.p.registers, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 512):
            np.minimum(least, (hashes[at : at + 512, None] * self.factors).min(0), out=least)
        smallest = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)) / self.p.rate
        return np.clip(np.floor(1 - np.log(smallest) / np.log(self.p.base)), 0, self.p.top).astype(np.uint16)

    def keys(self, registers: np.ndarray) -> np.ndarray:
        """Band keys, documents x bands, of documents x registers."""
        bands = registers.reshape(len(registers), self.p.bands, self.p.rows).astype(np.uint64)
        key = np.broadcast_to(self.salts, bands.shape[:2])
        for i in range(self.p.rows):
            key = mixed(key + bands[:, :, i])
        return key

    def estimate(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Maximum-likelihood similarity given the set sizes (closed form for b near 1), over the last axis."""
        more, less = (a > b).sum(-1), (a < b).sum(-1)
        same = self.p.registers - more - less
        u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
        x, y = u * u * (same + less), v * v * (same + more)
        return (x + y - np.sqrt((x - y) ** 2 + 4.0 * less * more * (u * v) ** 2)) / (2 * self.p.registers * u * v)


def binary_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), width)


def sketches(docs: DataFrame, params: NearParams) -> DataFrame:
    """(id, n, digest, regs) of every row; digest stands for the whole set, null where it is empty."""

    def run(batches):
        sketcher = Sketcher(params)
        for batch in batches:
            n, digests, regs = [], [], []
            for data in batch.column(1).to_pylist():
                s = shingles(data, params)
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=32).digest() if len(s) else None)
                regs.append(sketcher.sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], ["id", "n", "digest", "regs"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes("text")).mapInArrow(tidy(run), "id long, n long, digest binary, regs binary")


def banded(reps: DataFrame, params: NearParams) -> DataFrame:
    """(key, id, n): a row for each band of each representative."""

    def run(batches):
        sketcher = Sketcher(params)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                keys = sketcher.keys(binary_matrix(part.column(2), params.registers))
                wide = [np.repeat(part.column(i).to_numpy(zero_copy_only=False), params.bands) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *map(pa.array, wide)], ["key", "id", "n"])

    return reps.select("id", "n", "regs").mapInArrow(tidy(run), "key long, id long, n long")


def near_sizes(n: Column, m: Column, params: NearParams) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * params.percent


def attached(pairs: DataFrame, held: DataFrame, params: NearParams, *columns: str) -> DataFrame:
    """(a, b, and the columns of held (id, ...) of both). The columns of b travel with the pair; those of an a with many
    pairs are copied to so many salts that no more than params.salt pairs of it meet in one place."""
    hot = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / params.salt).cast("int").alias("salts")).where("salts > 1")
    salted = pairs.select("a", "b").join(hot, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    side = lambda x: held.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    dealt = side("a").join(pairs.select("a").distinct(), "a", "left_semi").join(hot, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return salted.join(side("b"), "b").join(dealt, ["a", "salt"]).drop("salt")


def likely(pairs: DataFrame, reps: DataFrame, params: NearParams) -> DataFrame:
    """The pairs (a, b) whose estimate doesn't rule out a link."""
    both = attached(pairs, reps, params, "n", "regs").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")

    def run(batches):
        sketcher = Sketcher(params)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                n_a, n_b = (part.column(i).to_numpy().astype(float) for i in (2, 3))
                j = sketcher.estimate(binary_matrix(part.column(4), params.registers), binary_matrix(part.column(5), params.registers), n_a, n_b)
                good = pa.array(j >= params.percent / 100 - params.slack)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["a", "b"])

    return both.mapInArrow(tidy(run), "a long, b long")


def full_sets(ids: DataFrame, docs: DataFrame, params: NearParams, paths: list[str]) -> DataFrame:
    """(id, s): full sets of at least the documents named, made again from their whole texts. A filter of bounded size
    over the ids keeps other documents' texts where they are."""
    ids = written(ids.toDF("digest").distinct(), "named", paths)
    bits = filter_bits(ids.count(), params.most_bits)
    passes = written(hit_filter(ids, bits), "filter", paths)
    mine = with_mark(docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes("text").alias("_text")), "id", passes, bits).where("_maybe")

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                sets = [shingles(x, params).view(np.int64) for x in part.column(1).to_pylist()]
                values = pa.array(np.concatenate(sets))
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], ["id", "s"])

    return written(mine.select("id", "_text").mapInArrow(tidy(run), "id long, s array<long>"), "sets", paths)


def verified(pairs: DataFrame, docs: DataFrame, params: NearParams, paths: list[str]) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""
    sets = full_sets(pairs.select("a").union(pairs.select("b")), docs, params, paths)
    both = attached(pairs, sets, params, "s")
    common = F.size(F.array_intersect("s_a", "s_b"))
    counted = both.select("a", "b", common.alias("common"), (F.size("s_a") + F.size("s_b")).alias("total"))
    return counted.where((F.col("common") * 100 >= (F.col("total") - F.col("common")) * params.percent)).select("a", "b").distinct()


def with_main(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, id, component, ...) of the groups that hold several components, with the component of which the group
    holds the most (main), numbers of its rows and of all (c_main, c), and is_main."""
    by_part = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("c"))
    stats = by_part.groupBy(key).agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("c_main"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    return rows.join(stats, key).withColumn("is_main", F.col("component") == F.col("main"))


def cells(rows: DataFrame, group: str, among: bool, *columns: str) -> DataFrame:
    """(kind, i, j, rows): what meets in one go. rows: (group, id, component, is_main, mb, ob) and further columns.

    A group's rows of its main component stand on one side, all others on the other; mb and ob are their numbers of
    blocks. Blocks of the first side meet those of the second (kind m), and, if among, those of the second meet each
    other (kind o). rows: structs of id, component, side and the columns.
    """
    mine = F.col("mine")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mb")).otherwise(F.col("ob"))).cast("int"))
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), (F.lit(side) if isinstance(side, int) else side).alias("side"))
    to_others = F.transform(F.sequence(F.lit(0), F.col("ob") - 1), lambda j: cell("m", mine, j, 0))
    to_main = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda i: cell("m", i, mine, 1))
    each_other = F.transform(F.sequence(F.lit(0), F.col("ob") - 1), lambda j: cell("o", F.least(mine, j), F.greatest(mine, j), F.when(mine <= j, 0).otherwise(1)))
    dealt = rows.withColumn("cell", F.explode(F.when(F.col("is_main"), to_others).otherwise(F.concat(to_main, each_other) if among else to_main)))
    held = F.collect_list(F.struct("id", "component", "cell.side", *columns)).alias("rows")
    return dealt.groupBy(group, "cell.kind", "cell.i", "cell.j").agg(held).where(F.size("rows") > 1).select("kind", "i", "j", "rows")


def sides(batch: pa.RecordBatch, g: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The places of a cell's two sides, and whether they are one block that meets itself."""
    one = batch.column(0)[g].as_py() == "o" and batch.column(1)[g].as_py() == batch.column(2)[g].as_py()
    return (np.arange(len(side)),) * 2 + (True,) if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1), False)


def pairs_batch(a_out: list[np.ndarray], b_out: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate(z).astype(np.int64) if z else np.zeros(0, np.int64) for z in (a_out, b_out))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def between(rows: DataFrame, reps: DataFrame, params: NearParams) -> DataFrame:
    """Candidate pairs (a, b) of different components in one group, by their estimate. rows: (key, id, n, component,
    c_main, c, is_main, first); first: whether a row of at least this one's size may meet it here. A task sees two
    blocks at a time and returns only pairs that may reach the threshold."""
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / params.block)).cast("int")
    rows = rows.join(reps.select("id", "regs"), "id").withColumn("mb", blocks(F.col("c_main"))).withColumn("ob", blocks(F.col("c") - F.col("c_main")))

    def run(batches):
        sketcher = Sketcher(params)
        for batch in batches:
            a_out, b_out = [], []
            for g in range(len(batch)):
                r = batch.column(3)[g].values
                ids, part, side, n, first = (r.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                regs = binary_matrix(r.field(5), params.registers)
                left, right, one = sides(batch, g, side)
                for x in left:
                    y = right[right > x] if one else right
                    met = np.where(n[y] < n[x], first[y], np.where(n[y] > n[x], first[x], first[x] | first[y]))
                    y = y[met & (part[y] != part[x]) & (ids[y] != ids[x]) & (100 * np.minimum(n[y], n[x]) >= params.percent * np.maximum(n[y], n[x]))]
                    if len(y):
                        j = sketcher.estimate(regs[x], regs[y], float(n[x]), n[y].astype(float))
                        y = y[j >= params.percent / 100 - params.slack]
                        a_out.append(np.minimum(ids[x], ids[y]))
                        b_out.append(np.maximum(ids[x], ids[y]))
            yield pairs_batch(a_out, b_out)

    return cells(rows, "key", True, "n", "first", "regs").mapInArrow(tidy(run), "a long, b long").distinct()


def shingle_counts(sets: DataFrame, params: NearParams) -> np.ndarray:
    """How many shingles of all these sets (s) fall into each hashed slot, at most 65,535; a bounded number of slots.

    A task counts what it reads and passes on its slots that are not empty, packed; a task for each stretch adds them up.
    """
    total = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    bits = max(10, min(params.count_bits, int(total).bit_length() + 1))
    log = max(bits - 6, 10)  # slots of a stretch

    def count(batches):
        seen = np.zeros(1 << bits, np.int64)
        for batch in batches:
            at, n = np.unique(slots_of(batch.column(0).flatten().to_numpy(), bits), return_counts=True)
            seen[at] += n
        for part, own in enumerate(seen.reshape(-1, 1 << log)):
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at.astype(np.uint32).tobytes()]), pa.array([own[at].tobytes()])], ["part", "at", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                sums.setdefault(part, np.zeros(1 << log, np.int64))[np.frombuffer(at, np.uint32)] += np.frombuffer(n, np.int64)
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(own, 65_535).astype(np.uint16).tobytes()])], ["part", "n"])

    packed = sets.select("s").mapInArrow(tidy(count), "part int, at binary, n binary")
    out = np.zeros((1 << bits - log, 1 << log), np.uint16)
    for row in packed.repartition("part").mapInArrow(tidy(add), "part int, n binary").toLocalIterator():
        out[row.part] = np.frombuffer(row.n, np.uint16)
    return out.reshape(-1)


def slots_of(s: np.ndarray, bits: int) -> np.ndarray:
    return (s.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def rare_shingles(sets: DataFrame, params: NearParams) -> DataFrame:
    """(key, id, component, of, n, first): the rarest shingles of each set (id, component, of, s), as far as it takes for
    a linked pair to share one, among all these sets; shingles of one set alone are left out where their slot shows it.

    A set linked with one of at least its own size shares at least ceil(2 t n / (1 + t)) shingles with it, and with a
    smaller one ceil(t n), so the first shared one, by rarity, is among the first n + 1 less that number (first, and all
    rows given, in this order). That holds in any order that all sets have in common; here it is by the count of the
    shingle's slot, which is its own or larger, and by the shingle. Other shingles don't leave their task.
    """
    t, counts = params.percent, shingle_counts(sets, params)
    bits = len(counts).bit_length() - 1

    def run(batches):
        for batch in batches:
            keys, rows, first = [], [], []
            for k, s in enumerate(batch.column(3)):
                s = s.values.to_numpy()
                n, seen = len(s), counts[slots_of(s, bits)]
                several = seen > 1  # the others come first in the order and are in no other set
                alone = n - int(several.sum())
                own = s[several][np.lexsort((s[several], seen[several]))][: max(0, n + 1 + (-t * n // 100) - alone)]
                keys.append(own)
                rows.append(np.full(len(own), k))
                first.append(np.arange(alone + 1, alone + 1 + len(own)) <= n + 1 + (-2 * t * n // (100 + t)))
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            n = pc.list_value_length(batch.column(3)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), *(batch.column(c).take(at) for c in range(3)), n.take(at), pa.array(np.concatenate(first) if first else np.zeros(0, bool))],
                names=["key", "id", "component", "of", "n", "first"],
            )

    return sets.select("id", "component", F.col("of").cast("long"), "s").mapInArrow(tidy(run), "key long, id long, component long, of long, n long, first boolean")


def in_wide(rows: DataFrame, docs: DataFrame, reps: DataFrame, params: NearParams, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of members (id, component, of) of wide buckets, and links found. of: members of the
    component in all.

    Members of small components meet where they share a rare shingle. A large component's members are near copies of
    each other, so that a straggler shares rare shingles with most of them: it meets all of them in blocks, by estimate
    and then full set, and returns one link for each component.
    """
    sets = full_sets(rows.select("id"), docs, params, paths)
    held = written(rows.join(sets, "id"), "held", paths)
    rare = written(rare_shingles(held, params), "rare", paths)
    few = F.col("of") <= params.block
    met = with_main(rare.where(few), "key")
    some = met.groupBy("key").agg(F.max("first").alias("any")).where("any").select("key")
    pairs = between(met.join(some, "key", "left_semi"), reps, params)
    # (main, id): what shares a rare shingle with a member of a large component.
    mains = rare.where(~few).select("key", F.col("component").alias("main")).distinct()
    others = written(rare.join(mains, "key").where("component <> main").select("main", "id").distinct(), "others", paths)
    if others.isEmpty():
        return pairs, pairs.limit(0)
    both = held.join(others, "id").withColumn("is_main", F.lit(False)).unionByName(held.where(~few).join(others.select(F.col("main").alias("component")).distinct(), "component", "left_semi").withColumn("main", F.col("component")).withColumn("is_main", F.lit(True)))
    per = lambda x: F.greatest(F.lit(1), F.ceil(F.sum(x.cast("int")) / (2 * params.block))).cast("int")
    blocks = both.groupBy("main").agg(per(F.col("is_main")).alias("mb"), per(~F.col("is_main")).alias("ob"))
    return pairs, around_large(both.join(blocks, "main").join(reps.select("id", "n", "regs"), "id"), params)


def around_large(rows: DataFrame, params: NearParams) -> DataFrame:
    """Links (a, b) between a large component and others: rows (main, id, component, is_main, mb, ob, s, n, regs)."""

    def run(batches):
        sketcher = Sketcher(params)
        for batch in batches:
            a_out, b_out = [], []
            for g in range(len(batch)):
                r = batch.column(3)[g].values
                ids, part, side, n = (r.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                regs, lists = binary_matrix(r.field(4), params.registers), r.field(5)
                ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                left, right, _ = sides(batch, g, side)
                for y in right:
                    x = left[(part[left] != part[y]) & (100 * np.minimum(n[left], n[y]) >= params.percent * np.maximum(n[left], n[y]))]
                    if len(x):
                        x = x[sketcher.estimate(regs[x], regs[y], n[x].astype(float), float(n[y])) >= params.percent / 100 - params.slack]
                    own = values[ends[y] : ends[y + 1]]
                    for k in x:  # one link with the component will do
                        theirs = values[ends[k] : ends[k + 1]]
                        place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                        common = int((own[place] == theirs).sum())
                        if 100 * common >= params.percent * (n[k] + n[y] - common):
                            a_out.append(np.minimum(ids[k : k + 1], ids[y]))
                            b_out.append(np.maximum(ids[k : k + 1], ids[y]))
                            break
            yield pairs_batch(a_out, b_out)

    return cells(rows, "main", False, "n", "regs", "s").mapInArrow(tidy(run), "a long, b long")


def near_dedup(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    Null and empty texts and texts of white space have an empty set and stay alone. Equal sets are linked. Rows with a
    null doc_id can't be named by a link: component_id is null and they stay. Rows that repeat a doc_id are one node
    with all their texts, and each gets that node's component. An empty table gives an empty result.
    """
    spark, paths = docs.sparkSession, []
    sketch = written(sketches(docs, params), "sketches", paths)
    named = sketch.where("n > 0 and id is not null")
    # Equal sets have equal sketches, so any row's will do.
    reps = written(named.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")), "reps", paths)
    bands = banded(reps, params)
    buckets = bands.groupBy("key").agg(F.min(F.struct("id", "n")).alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = written(buckets.select("key", "pivot.id", "pivot.n"), "buckets", paths)
    bits = filter_bits(buckets.count(), params.most_bits)
    passes = written(hit_filter(buckets.select(F.col("key").alias("digest")), bits), "filter", paths)
    members = with_mark(bands, "key", passes, bits).where("_maybe").drop("_maybe")
    members = written(members.join(buckets.select("key", F.col("id").alias("pivot"), F.col("n").alias("m")), "key"), "members", paths)
    tries = members.where((F.col("id") != F.col("pivot")) & near_sizes(F.col("n"), F.col("m"), params)).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    tried = written(likely(tries, reps, params), "tried", paths)
    links = written(verified(tried, docs, params, paths), "links", paths)
    parts = components(links, paths)
    of = parts.groupBy("component").agg(F.count(F.lit(1)).alias("of"))
    rest = members.join(parts, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    open_rows = with_main(rest, "key").join(of.withColumnRenamed("component", "main"), "main", "left")
    open_rows = written(open_rows.withColumn("wide", F.coalesce(F.col("of") > params.block, F.lit(False)) | (F.col("c") > params.block)).drop("of"), "open", paths)
    more = between(open_rows.where("not wide").withColumn("first", F.lit(True)), reps, params)
    wide = written(open_rows.where("wide").select("id", "component").distinct().join(of, "component", "left").withColumn("of", F.coalesce("of", F.lit(1))), "wide", paths)
    if not wide.isEmpty():
        met, found_links = in_wide(wide, docs, reps, params, paths)
        more, links = more.union(met).distinct(), links.union(found_links)
    more = written(more.join(tried, ["a", "b"], "left_anti"), "more", paths)
    more = verified(more, docs, params, paths)
    # The links found before are held by their components.
    links = written(links.union(more), "links", paths)
    parts = components(parts.select("id", "component").union(links), paths)
    found = sketch.select("id", "n", "digest").join(reps.select("digest", F.col("id").alias("rep")), "digest", "left")
    # A row whose set is some other row's as well belongs to the representative; its id may have links under other texts.
    same = found.where("rep is not null and id is not null and id <> rep").select("id", "rep").distinct()
    twice = named.groupBy("id").agg(F.count_distinct("digest").alias("c")).where("c > 1").select("id")
    if not twice.isEmpty():  # repeated ids tie their texts together
        links = links.select("a", "b").union(same)
        parts = components(links, paths)
        found = found.withColumn("rep", F.col("id"))
    out = found.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
    keep: list[str] = []
    out = written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near", keep)
    drop_paths(spark, paths)
    return out
