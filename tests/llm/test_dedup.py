"""Exact and near dedup, components and mixing, against plain Python."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec.llm import near_dedup as near_module
from lodevec.llm.components import components, local_roots
from lodevec.llm.exact_dedup import DedupParams, DigestIndex, exact_dedup, filter_bits, hit_filter, with_mark
from lodevec.llm.mixing import MixParams, draw_key, hypergeometric, leaf_counts, mix, mix_plan, place_of, source_targets
from lodevec.llm.near_dedup import NearParams, Sketcher, near_dedup, shingles

ODD = "doc_id long, text string, digest string, _row string, kept string, source string"


def odd_rows():
    """Nulls, empties, ties, repeats, a very long text, and columns whose names clash with inner ones."""
    texts = [(1, "a b"), (2, "a b"), (2, "a b"), (3, None), (4, ""), (5, " "), (None, "a b"), (None, "lonely"), (None, "lonely"), (6, "x " * 150_000), (7, "x " * 150_000), (8, "é"), (9, "é")]
    return [(i, t, "d", "r", "k", None if i == 1 else "s") for i, t in texts]


def plain_exact(rows, best):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = best(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("params, best", [(DedupParams(), max), (DedupParams(keep="smallest", digest_bytes=1, most_bits=16, memtables=2), min)])
def test_exact_dedup(spark, params, best):
    rows = odd_rows() + [(100 + i, f"t{i % 40}", "", "", "", "") for i in range(120)]
    got = exact_dedup(spark.createDataFrame(rows, ODD), params)
    assert {"digest", "_row", "source"} <= set(got.columns)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.select("doc_id", "keep_id", "group_size", "kept").collect()), key=str) == plain_exact(rows, best)
    assert exact_dedup(spark.createDataFrame([], ODD), params).count() == 0


def plain_near(rows):
    def own(text):
        words = (text or "").encode().lower().split()
        k = min(5, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    sets = [own(t) for _, t, *_ in rows]
    up = {i: i for i, *_ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(zip([r[0] for r in rows], sets), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    return sorted((r[0], len(s), top(r[0])) for r, s in zip(rows, sets))


def copies(seed, groups, size, words, most):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{draw.randrange(4000)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(draw.randrange(most + 1)):
                text[draw.randrange(words)] = f"n{draw.randrange(9999)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_near_dedup_against_all_pairs(spark):
    rows = copies(1, 12, 6, 120, 8) + [(1000, None), (1001, ""), (1002, "Same words"), (1003, "same  WORDS"), (1004, "one"), (1005, " \n ")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_near(rows)
    assert got.where("kept <> (doc_id = component_id)").isEmpty()


def test_near_dedup_around_a_large_group(spark):
    """A group beyond the block size, so its stragglers meet the full sets."""
    rows = copies(2, 1, 60, 60, 6) + [(500 + i, t) for i, t in copies(3, 3, 4, 60, 4)]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), NearParams(block=4))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_near(rows)


def test_near_dedup_odd_rows(spark):
    frame = spark.createDataFrame(odd_rows(), ODD)
    got = near_dedup(frame).collect()
    assert len(got) == len(odd_rows())
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}
    assert found == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, 1, None, True), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (9, 1, 9, True)}
    assert near_dedup(frame.limit(0)).count() == 0


def test_estimates_are_near_the_truth():
    p, draw = NearParams(), np.random.default_rng(5)
    s = Sketcher(p)
    a = draw.integers(0, 1 << 62, 900, np.uint64)
    b = np.concatenate([a[:700], draw.integers(0, 1 << 62, 100, np.uint64)])
    ra, rb = s.sketch(a), s.sketch(b)
    assert abs(s.estimate(ra, rb, 900.0, 800.0) - 0.7) < 0.12
    assert (np.maximum(ra, rb) == s.sketch(np.union1d(a, b))).all()  # sketches merge
    assert len(shingles(b"A b a B a b a b", p)) == 2 and len(shingles(b"", p)) == 0


def test_the_index_answers_from_its_runs(spark):
    """Runs hold what another run has as well; only such rows are merged, and counts and ids come from the index."""
    rows = [(i, f"t{i % 50 if i < 100 else i}") for i in range(400)]
    index = DigestIndex(spark, f"{spark.conf.get('spark.checkpoint.dir')}/runs", DedupParams())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index.flush(docs.where("doc_id < 200"))
    index.flush(docs.where("doc_id >= 200"))
    assert index.runs == list(range(8))
    paths = []
    again = {(bytes(r.digest), r.run) for r in index.table().collect()}
    runs = {}
    for digest, run in again:
        runs.setdefault(digest, set()).add(run)
    probed = {bytes(r.digest): r._again for r in index.probed(paths).collect()}
    assert all(probed[d] for d, held in runs.items() if len(held) > 1)  # filters miss nothing
    assert sum(probed[d] for d, held in runs.items() if len(held) == 1) < 0.9 * sum(len(held) == 1 for held in runs.values())
    index.compact()
    held = {hashlib.sha256(t.encode()).digest(): (max(j for j, x in rows if x == t), sum(x == t for _, x in rows)) for _, t in rows}
    assert {bytes(r.digest): (r.id, r.n) for r in index.table().collect()} == held
    assert {bytes(r.digest) for r in index.hits().collect()} == {d for d, (_, n) in held.items() if n > 1}


def test_filters_miss_nothing_and_grow_with_their_digests(spark):
    assert filter_bits(0) == 15 and filter_bits(1_000) == 15 and filter_bits(100_000) == 21 and filter_bits(1 << 40) == 30
    some = spark.range(0, 9_000, 3).toDF("digest")
    bits = filter_bits(3_000)
    marked = with_mark(spark.range(9_000), "id", hit_filter(some, bits), bits).where("_maybe")
    assert marked.where("id % 3 = 0").count() == 3_000 and marked.where("id % 3 <> 0").count() < 1_200


def boiler(n, shared, own, seed=9):
    """Texts that share a passage and little else."""
    draw = random.Random(seed)
    passage = [f"b{i}" for i in range(shared)]
    return [(i, " ".join(passage + [f"u{draw.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


def test_near_dedup_with_boilerplate(spark):
    """No two texts are linked though they share most of their words; near copies among them are found."""
    rows = boiler(120, 60, 25) + boiler(60, 60, 40, 4)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(1000 + i, t + " more") for i, t in rows[::30]]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), NearParams(block=8))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_near(rows)


def test_rare_shingles_grow_with_the_rows(spark):
    """Of the shared passage nothing is among the rarest shingles that a pair must share, however many rows there are."""
    params = NearParams()
    for n in (50, 200):
        sets = [(i, i, 1, sorted(int(x) for x in shingles(t.encode(), params).view(np.int64))) for i, t in boiler(n, 100, 40)]
        rare = near_module.rare_shingles(spark.createDataFrame(sets, "id long, component long, of long, s array<long>"), params)
        assert rare.groupBy("key").agg(F.max("first").alias("any")).where("any").count() == 0


def test_only_rare_shingles_leave_their_task(spark):
    shared, sets = list(range(1, 301)), []
    for i in range(120):  # a passage that all have, and pairs that share the rest as well
        sets.append((i, i, 1, sorted(shared + list(range(1_000 * (i // 2 + 1), 1_000 * (i // 2 + 1) + 100)))))
    rows = spark.createDataFrame(sets, "id long, component long, of long, s array<long>").repartition(5)
    params = NearParams()
    rare = near_module.rare_shingles(rows, params)
    assert "Generate" not in rare._jdf.queryExecution().executedPlan().toString()
    got = rare.collect()
    assert len(got) == 120 * 101 and {r.n for r in got} == {400}  # 400 + 1 - 300 each
    mine = {i: {r.key for r in got if r.id == i} for i in range(120)}
    assert all(len(mine[i] & mine[i + 1]) >= 100 for i in range(0, 120, 2))
    # Slots that are shared change the order, not that it is one and the same for all.
    few = near_module.rare_shingles(rows, NearParams(count_bits=10)).collect()
    mine = {i: {r.key for r in few if r.id == i} for i in range(120)}
    assert all(mine[i] & mine[i + 1] for i in range(0, 120, 2))


def test_rare_shingles_keep_every_pair():
    """Of a linked pair the smaller set's first ones and the larger set's ones share a shingle."""
    draw = random.Random(2)
    t, linked = NearParams().percent, 0
    for _ in range(4_000):
        n = draw.randrange(1, 60)
        base = draw.sample(range(200), n)
        a, b = set(base), {x if draw.random() > 0.1 else 300 + draw.randrange(100) for x in base} | set(draw.sample(range(200), draw.randrange(4)))
        if len(a) > len(b):
            a, b = b, a
        if 100 * len(a & b) >= t * len(a | b):
            linked += 1
            order = [*range(500)]
            draw.shuffle(order)
            rare = lambda s, need: set(sorted(s, key=lambda x: order[x])[: len(s) + 1 - need])
            assert rare(a, -(-2 * t * len(a) // (100 + t))) & rare(b, -(-t * len(b) // 100))
    assert linked > 500


def test_recall_near_the_threshold(spark):
    """Pairs at a similarity of 0.75 to 0.80, which bands and estimates miss most easily."""
    draw, rows, want = random.Random(8), [], 0
    while want < 400:
        words = [f"w{draw.randrange(10**7)}" for _ in range(150)]
        other = list(words)
        for at in draw.sample(range(0, 150, 10), 4):
            other[at] = f"x{draw.randrange(10**7)}"
        a, b = (set(zip(*(x[i:] for i in range(5)))) for x in (words, other))
        if 0.75 <= len(a & b) / len(a | b) < 0.80:
            rows += [(2 * want, " ".join(words)), (2 * want + 1, " ".join(other))]
            want += 1
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("doc_id % 2 = 1 and component_id = doc_id - 1").count() >= 0.99 * want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 101), (7, 7), (200, 200), (101, 100)]
    draw = random.Random(1)
    draw.shuffle(chain)
    paths = []
    for run in (1_000_000, 10):  # one task ends the work at once, or when the steps have left few edges (here never)
        got = {r.id: r.component for r in components(spark.createDataFrame(chain, "x long, y long").repartition(4), paths, run).collect()}
        assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 105: 100}
    assert components(spark.createDataFrame([], "x long, y long"), paths).count() == 0
    nodes, roots = local_roots(np.array([5, 4, 9]), np.array([4, 3, 8]))
    assert dict(zip(nodes.tolist(), roots.tolist())) == {4: 3, 5: 3, 9: 8}


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: (goal - sum(out.values())) * w[s] / sum(w[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
    return out


def test_mixing(spark):
    draw = random.Random(7)
    rows = []
    for i in range(400):
        source = draw.choice(["b", "a", None, "é", "c", "c", "c", "empty"])
        rows.append((i, "" if source == "empty" else "w " * draw.randrange(1, 60), source, "x", "y"))
    rows += [(None, "w w", "a", "", ""), (5, None, "a", "", ""), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size string, unit string")
    params = MixParams(block_words=50)
    got = mix_plan(docs, params).select("_row.doc_id", "_row.source", "_size", "_source_size", "_target", "_copies").collect()
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        taken = sum(len(r._copies) * r._size for r in mine)
        assert all(abs(r._target - want[s]) < 1e-6 and r._source_size == sizes[s] for r in mine)
        assert taken <= want[s] + 1e-6 and taken >= 0.97 * want[s] - 60
    assert max(len(r._copies) for r in got) <= 2
    shards = [0] * 16
    for r in got:
        for c in r._copies:
            shards[c.shard] += r._size
    assert min(shards) > 0
    again = mix_plan(docs.repartition(7), params).select("_row.doc_id", "_size", "_copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mix_plan(docs, params).select("_row.doc_id", "_size", "_copies").collect())
    out = mix(docs, params)
    assert out.columns == docs.columns and out.count() == sum(len(r._copies) for r in got)
    assert mix(docs.limit(0), params).count() == 0


def test_hypergeometric_draws(spark):
    u = "(shiftrightunsigned(xxhash64(id), 11) / 9007199254740992D)"
    draw = lambda n, q, t: spark.range(4000).select(F.expr(hypergeometric(str(n), str(q), str(t), u)).alias("x")).agg(F.avg("x"), F.var_samp("x"), F.min("x"), F.max("x")).first()
    mean, var, low, high = draw(40, 30, 100)
    assert abs(mean - 12) < 0.15 and abs(var - 40 * 0.3 * 0.7 * 60 / 99) < 0.4
    assert draw(5, 5, 5)[0] == 5 and draw(0, 3, 9)[0] == 0 and draw(0, 0, 0)[0] == 0 and draw(3, 2, 3)[2:] == (2, 2)


def test_quotas_are_split_exactly(spark):
    totals = spark.createDataFrame([("a", 70_000), ("b", 0), ("c", 1_000_000), (None, 900), ("d", 40)], "source string, source_size long")
    params = MixParams(levels=3, block_words=100, leaf_blocks=64)
    targets = source_targets(totals, params)
    rows = {r.sid: r for r in targets.collect()}
    assert [rows[i].source for i in range(5)] == ["a", "b", "c", "d", None] and [rows[i].leaves for i in range(5)] == [16, 8, 256, 8, 8]
    draws = {}
    for r in leaf_counts(targets, params, []).collect():
        draws.setdefault(r.sid, {})[r.leaf] = r.draws
    for sid, r in rows.items():
        quota = int(r.more / max(r.source_size, 1) * r.blocks)
        assert sum(draws.get(sid, {}).values()) == quota
        for leaf, n in draws.get(sid, {}).items():
            assert 0 < n <= -(-(leaf + 1) * r.blocks // r.leaves) + (leaf * -r.blocks // r.leaves)
    spread = np.array([draws[2].get(i, 0) for i in range(256)])
    p = rows[2].more / rows[2].source_size
    assert 0.5 < spread.var() / (10_000 / 256 * p * (1 - p)) < 1.6  # hypergeometric, not even


def plain_mix(spark, docs, params):
    """The draw gone through block by block in plain Python, from the tree's counts: copies of each (doc_id, size)."""
    sized = docs.selectExpr("doc_id as _doc", "source", "size(filter(split(text, ' '), w -> w <> '')) as _size").withColumn("_size", F.col("_size").cast("long")).where("_size > 0")
    targets = source_targets(sized.groupBy("source").agg(F.sum("_size").alias("source_size")), params)
    draws = {(r.sid, r.leaf): r.draws for r in leaf_counts(targets, params, []).collect()}
    on = sized.join(targets, "source").withColumn("block", F.pmod(draw_key(params, "_doc", "_size"), "blocks"))
    on = on.withColumn("place", place_of(params, F.col("sid"), F.col("block"), F.col("blocks"), F.lit(-1)))
    out, sources = {}, {}
    for r in on.collect():
        leaf = r.place * r.leaves // r.blocks
        drawn = r.place - -(-leaf * r.blocks // r.leaves) < draws.get((r.sid, leaf), 0)
        sources.setdefault(r.sid, (r.more, {}))[1].setdefault((not drawn, r.place), []).append((r._size, r._doc))
        out[r._doc] = r.whole
    for left, blocks in sources.values():
        for key in sorted(blocks):
            fits = [x for x in blocks[key] if x[0] <= left]
            if sum(x[0] for x in fits) <= left:
                took = fits
            else:
                took, room = [], left
                for x in sorted(fits, reverse=True):
                    if x[0] <= room:
                        took.append(x)
                        room -= x[0]
            for size, doc in took:
                left -= size
                out[doc] += 1
    return out


def test_the_tree_decides_the_draw(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.randrange(1, 90), "ab"[i % 2]) for i in range(600)] + [(700, "w " * 3_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for params in (MixParams(block_words=200), MixParams(block_words=200, seed=5), MixParams(block_words=200, levels=0, leaf_blocks=4)):
        got = {r.doc_id: len(r._copies) for r in mix_plan(docs, params).select("_row.doc_id", "_copies").collect()}
        assert got == plain_mix(spark, docs, params)
        assert got not in seen  # other levels or another seed: another draw
        seen.append(got)


def test_mixing_many_sources(spark):
    docs = spark.range(3_000).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 + 1 as int)) as text", "concat('s', id % 500) as source")
    got = mix_plan(docs, MixParams(share=100)).select("_row.source", "_size", "_target", "_copies").groupBy("source").agg(F.sum(F.size("_copies") * F.col("_size")).alias("taken"), F.first("_target").alias("target")).collect()
    assert len(got) == 500 and all(r.target - 7 < r.taken <= r.target + 1e-6 for r in got)
