"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are hashed into blocks of their source. A source is taken in whole epochs, each with a permutation of its
blocks of its own, and in a partial epoch that takes a quota of blocks for what is left of its target. A binary tree
splits each quota among the output shards: a node holds a stretch of permuted places and how many draws fall into it,
and the left half's draws come from the hypergeometric distribution. The draws of all leaves together are multivariate
hypergeometric and sum to the quota. Each leaf draws its number of blocks from its own stretch; the stretches are
disjoint, so no block is drawn twice in an epoch. Shards are shuffled locally.

Blocks differ in words, so the draw is then fitted to the target in words: the drawn blocks are gone through leaf by
leaf, and after them the others. All their documents are taken up to the block that would exceed the target; of that one
the largest first while they fit, and what is left goes on to the blocks after it until no document fits.

All draws come from keyed hashes: reruns agree. DataFrame and SQL functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodevec.llm.common import boxed, drop_paths, words_column, written
from lodevec.operators.index import dense_positions


@dataclass(frozen=True)
class MixParams:
    """weights: of the sources by code point (null last), repeating; share: words of the mix in hundredths of all words;
    most: times that a source's words may be taken; block_words: words that a block aims at; levels: the mix has
    2**levels output shards; leaf_blocks: blocks that a leaf of a source's tree holds at most, so large sources have
    deeper trees; seed: of blocks, permutations and the tree."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: int = 150
    most: int = 2
    block_words: int = 20_000
    levels: int = 4
    leaf_blocks: int = 1_024
    seed: int = 17


#: Primes above 2**31, so that multiplying by them permutes the places of up to 2**31 blocks.
PRIMES = (2147483659, 2147483693, 2147483713, 2147483743)


def source_targets(totals: DataFrame, p: MixParams) -> DataFrame:
    """(source, sid, source_size, target, whole, more, blocks, leaves) from (source, source_size), a row for each source.

    whole: epochs that take all of it; more: words of the partial epoch; sid: place by code point. What targets above
    the cap leave over is shared anew by weight until none is above; a round is an aggregate of one row.
    """
    # Strings order by their UTF-8 bytes, which is by code point.
    named = totals.where("source is not null")
    last = totals.agg(F.count("source")).first()[0]
    both = dense_positions(named, "source", last).withColumnRenamed("_pos", "sid").unionByName(totals.where("source is null").withColumn("sid", F.lit(last).cast("long")))
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (F.col("sid") % len(p.weights) + 1).cast("int")).cast("double")
    t = both.withColumn("w", weight).withColumn("cap", (F.col("source_size") * p.most).cast("double"))
    level, n = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("cap") < F.col("w") * level
        goal, caps, weights, now = t.agg(F.sum("source_size") * (p.share / 100.0), F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w"))), F.sum(above.cast("int"))).first()
        if now is None or now == n or not weights:
            break
        level, n = (goal - caps) / weights, now
    target = F.least(F.col("w") * (level or 0.0), "cap") if now is None or weights else F.col("cap")
    size = F.greatest("source_size", F.lit(1))
    t = t.withColumn("target", target).withColumn("whole", F.floor(F.col("target") / size).cast("int"))
    t = t.withColumn("more", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / p.block_words)).cast("long"))
    depth = F.greatest(F.lit(p.levels), F.ceil(F.log2(F.col("blocks") / p.leaf_blocks)))
    return t.select("source", "sid", "source_size", "target", "whole", "more", "blocks", F.expr("1L").alias("_one"), depth.cast("int").alias("depth")).withColumn("leaves", F.expr("shiftleft(_one, depth)")).drop("_one", "depth")


def draw_key(p: MixParams, *columns: str | Column) -> Column:
    return F.xxhash64(F.lit(p.seed), *columns)


def place_of(p: MixParams, sid: Column, block: Column, blocks: Column, epoch: Column) -> Column:
    """Where an epoch's permutation puts a block: 0 up to blocks. Blocks are filled by hash, so that their own numbers
    are in random order already."""
    factor = F.element_at(F.array(*(F.lit(x).cast("long") for x in PRIMES)), (F.pmod(draw_key(p, sid, epoch, F.lit("factor")), F.lit(len(PRIMES))) + 1).cast("int"))
    return F.pmod(block * factor + F.pmod(draw_key(p, sid, epoch, F.lit("shift")), blocks), blocks)


#: One draw from the hypergeometric distribution by inversion: of `n` drawn from `tot` with `q` good ones, the number of
#: good ones. The pmf is walked by its ratios over 12 standard deviations about the mode, beyond which a double sees 0.
_SPAN = "cast(12 * sqrt(greatest(0D, 1D * n * q / greatest(tot, 1) * (1 - 1D * q / greatest(tot, 1)) * (tot - n) / greatest(tot - 1, 1))) + 12 as bigint)"
_MODE = "cast(floor((n + 1D) * (q + 1D) / (tot + 2D)) as bigint)"
_RATIO = "(1D * (q - k) * (n - k) / ((k + 1D) * (tot - q - n + k + 1D)))"


def hypergeometric(n: str, q: str, tot: str, u: str) -> str:
    """SQL for the draw; u: SQL for a uniform number in [0, 1)."""
    span, mode, ratio = (_named(x) for x in (_SPAN, _MODE, _RATIO))
    lo, hi = "greatest(0L, z.n - (z.tot - z.q))", "least(z.q, z.n)"
    low, high = f"greatest({lo}, {mode} - {span})", f"least({hi}, {mode} + {span})"
    box = f"named_struct('n', cast({n} as bigint), 'q', cast({q} as bigint), 'tot', cast({tot} as bigint), 'u', {u})"
    # z: the arguments; y: with the walk's ends; x: with the weights' sum.
    walk = f"transform(array({box}), z -> named_struct('z', z, 'low', {low}, 'high', {high}))"
    step = f"named_struct('w', a.w * {ratio.replace('z.', 'y.z.')}, 's', a.s + a.w)"
    summed = f"transform({walk}, y -> named_struct('y', y, 's', aggregate(sequence(y.low, y.high), named_struct('w', 1D, 's', 0D), (a, k) -> {step}, a -> a.s)))"
    find = f"named_struct('w', a.w * {ratio.replace('z.', 'x.y.z.')}, 's', a.s + a.w, 'at', if(a.s + a.w <= x.y.z.u * x.s, k + 1, a.at))"
    pick = f"aggregate(sequence(x.y.low, x.y.high), named_struct('w', 1D, 's', 0D, 'at', x.y.low), (a, k) -> {find}, a -> least(a.at, x.y.high))"
    return f"element_at(transform({summed}, x -> {pick}), 1)"


def _named(sql: str) -> str:
    """The formulas above with their letters read from a struct z."""
    return re.sub(r"\b(n|q|tot)\b", r"z.\1", sql)


def leaf_counts(targets: DataFrame, p: MixParams, paths: list[str]) -> DataFrame:
    """(sid, leaf, draws): how many blocks each leaf draws in the partial epoch; leaves without a draw get no row.

    Every level of the tree doubles the rows of the sources that go on to it; no row holds more than one node.
    """
    start = "(({0}) * blocks + leaves - 1) div leaves"  # first place of a leaf's stretch
    # lo, hi: leaves of the node; q: its draws.
    quota = F.floor(F.col("more") / F.greatest("source_size", F.lit(1)) * F.col("blocks")).cast("long")
    nodes = targets.select("sid", "blocks", "leaves", F.lit(0).cast("long").alias("lo"), F.col("leaves").alias("hi"), F.least(quota, "blocks").alias("q")).where("q > 0")
    deepest = targets.agg(F.max("leaves")).first()[0] or 1
    for level in range(deepest.bit_length() - 1):
        mid = "((lo + hi) div 2)"
        u = f"(shiftrightunsigned(xxhash64({p.seed}, {level}, sid, lo), 11) / 9007199254740992D)"
        draw = hypergeometric("q", f"{start.format(mid)} - {start.format('lo')}", f"{start.format('hi')} - {start.format('lo')}", u)
        halves = f"array(named_struct('lo', lo, 'hi', {mid}, 'q', l), named_struct('lo', {mid}, 'hi', hi, 'q', q - l))"
        whole = "array(named_struct('lo', lo, 'hi', hi, 'q', q))"
        nodes = nodes.withColumn("l", F.expr(f"if(hi - lo > 1, {draw}, 0L)")).select("sid", "blocks", "leaves", F.explode(F.expr(f"if(hi - lo > 1, {halves}, {whole})")).alias("h"))
        nodes = nodes.select("sid", "blocks", "leaves", "h.lo", "h.hi", "h.q").where("q > 0")
        if level % 6 == 5:
            nodes = written(nodes, "nodes", paths)
    return nodes.select("sid", F.col("lo").alias("leaf"), F.col("q").alias("draws"))


def first_over(sums: DataFrame, place: str) -> DataFrame:
    """(sid, place, rest): for each source the first place at which running words exceed left, and what is left before
    it. sums: (sid, place, words, left)."""
    order = W.partitionBy("sid").orderBy(place)
    running = sums.withColumn("before", F.sum("words").over(order) - F.col("words")).where("before + words > left")
    return running.groupBy("sid").agg(F.min(F.struct(place, F.expr("left - before").alias("rest"))).alias("o")).select("sid", f"o.{place}", "o.rest")


def fitted(rows: DataFrame, targets: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """What the partial epochs take, as (sid, rounds) and (sid, doc, size).

    rows: (sid, lane, rank, doc, size); lanes are runs of ranks of at most leaf_blocks blocks. A document is taken if
    its size is within what a round has left and its block between where the round begins and its cut; rounds: structs
    (after, cut, left). The second frame names the documents taken from the cuts' blocks. Sums go by lane first, and
    ranks are only ranked inside the lane where the cut is. A list holds the documents of one block.
    """
    chosen_sql = """aggregate(list, named_struct('left', rest, 'took', cast(array() as array<struct<doc:bigint,size:bigint>>)),
        (a, x) -> if(x.words <= a.left, named_struct('left', a.left - x.words, 'took', concat(a.took, array(x.unit))), a))"""
    state = targets.where("more >= 1").select("sid", F.lit(-1).cast("long").alias("after"), F.col("more").alias("left"))
    rounds, chosen = [], []
    while not state.isEmpty():
        fit = rows.join(state, "sid").where("rank > after and size <= left")
        lanes = fit.groupBy("sid", "lane").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        inside = fit.drop("left").join(first_over(lanes, "lane").withColumnRenamed("rest", "left"), ["sid", "lane"])
        cut = written(first_over(inside.groupBy("sid", "rank").agg(F.sum("size").alias("words"), F.first("left").alias("left")), "rank"), "cut", paths)
        units = rows.join(cut, ["sid", "rank"]).where("size <= rest").groupBy("sid", "rank", "rest", F.struct("doc", "size").alias("unit")).agg(F.sum("size").alias("words"))
        lists = units.groupBy("sid", "rank").agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("words", "unit")), asc=False).alias("list"))
        rounds.append(state.join(cut.select("sid", F.col("rank").alias("cut")), "sid", "left").select("sid", "after", "cut", "left"))
        lists = cut.join(lists.drop("rest"), ["sid", "rank"], "left").withColumn("list", F.coalesce("list", F.expr("cast(array() as array<struct<words:bigint,unit:struct<doc:bigint,size:bigint>>>)")))
        took = written(lists.select("sid", "rank", F.expr(chosen_sql).alias("c")).select("sid", "rank", "c.left", "c.took"), "took", paths)
        chosen.append(took.select("sid", F.explode("took").alias("u")).select("sid", "u.doc", "u.size"))
        state = took.where("left >= 1").select("sid", F.col("rank").alias("after"), "left")
    empty = rows.sparkSession.createDataFrame([], "sid long, after long, cut long, left double, doc long, size long")
    every, took = empty.select("sid", "after", "cut", "left"), empty.select("sid", "doc", "size")
    for a, b in zip(rounds, chosen):
        every, took = every.unionByName(a), took.unionByName(b)
    return every.groupBy("sid").agg(F.collect_list(F.struct("after", "cut", "left")).alias("rounds")), took


def mix_plan(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(_row, _size, _source_size, _target, _copies): docs' columns as a struct, and an array of (epoch, shard) with one
    entry each time the row is taken.

    docs: any columns with doc_id, source and text. Null text has no words; rows without words are taken 0 times. A null
    source is a source of its own, last in order. Rows that repeat doc_id and size stand or fall together; a null doc_id
    is a value like any other. An empty table gives an empty result.
    """
    p, paths = params, []
    rows = boxed(docs, _doc=F.col("doc_id").cast("long"), _from=F.col("source").cast("string"), _size=words_column(F.col("text")))
    slim = written(rows.select("_doc", "_from", "_size"), "sizes", paths)  # texts are searched for words once
    totals = written(slim.groupBy(F.col("_from").alias("source")).agg(F.sum("_size").alias("source_size")), "totals", paths)
    kept: list[str] = []
    targets = written(source_targets(totals, p), "targets", kept)
    leaves = written(leaf_counts(targets, p, paths), "leaves", kept)
    mine = targets.select(F.col("source").alias("_source"), F.col("sid").alias("_sid"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("whole").alias("_whole"), F.col("blocks").alias("_blocks"), F.col("leaves").alias("_leaves"))
    draws = leaves.select(F.col("sid").alias("_s"), F.col("leaf").alias("_l"), "draws")

    def placed(frame: DataFrame) -> DataFrame:
        """frame with its source's row, the block and the rank in the partial epoch."""
        out = frame.join(mine, F.col("_from").eqNullSafe(F.col("_source"))).drop("_source")
        out = out.withColumn("_block", F.pmod(draw_key(p, "_doc", "_size"), "_blocks"))
        out = out.withColumn("_place", place_of(p, F.col("_sid"), F.col("_block"), F.col("_blocks"), F.lit(-1))).withColumn("_leaf", F.expr("_place * _leaves div _blocks"))
        out = out.join(draws, (F.col("_s") == F.col("_sid")) & (F.col("_l") == F.col("_leaf")), "left")
        drawn = F.expr("_place - (_leaf * _blocks + _leaves - 1) div _leaves < coalesce(draws, 0)")
        return out.withColumn("_rank", F.col("_place") + F.when(drawn, 0).otherwise(F.col("_blocks"))).withColumn("_lane", F.col("_leaf") + F.when(drawn, 0).otherwise(F.col("_leaves"))).drop("_s", "_l", "draws")

    ranked = placed(slim.where("_size > 0")).select(F.col("_sid").alias("sid"), F.col("_lane").alias("lane"), F.col("_rank").alias("rank"), F.col("_doc").alias("doc"), F.col("_size").alias("size"))
    rounds, chosen = fitted(written(ranked, "ranked", paths), targets, paths)
    rounds = written(rounds.withColumnRenamed("sid", "_r"), "rounds", kept)
    chosen = written(chosen.select(F.col("sid").alias("_c"), F.col("doc").alias("_d"), F.col("size").alias("_z")).distinct().withColumn("_more", F.lit(True)), "chosen", kept)
    drop_paths(docs.sparkSession, paths)
    out = placed(rows).join(rounds, F.col("_r") == F.col("_sid"), "left")
    out = out.join(chosen, (F.col("_c") == F.col("_sid")) & F.col("_d").eqNullSafe(F.col("_doc")) & (F.col("_z") == F.col("_size")), "left")
    extra = F.expr("coalesce(_more, false) or exists(coalesce(rounds, array()), r -> _rank > r.after and (r.cut is null or _rank < r.cut) and _size <= r.left)")
    # A source's stretches begin at a shard of its own, so that sources of one block don't meet in one shard.
    turn = lambda epoch: F.pmod(draw_key(p, F.col("_sid"), epoch, F.lit("turn")), F.lit(1 << p.levels))
    shard = lambda epoch: ((F.floor(place_of(p, F.col("_sid"), F.col("_block"), F.col("_blocks"), epoch) * (1 << p.levels) / F.col("_blocks")) + turn(epoch)) % (1 << p.levels)).cast("int")
    whole = F.when(F.col("_whole") > 0, F.transform(F.sequence(F.lit(0), F.col("_whole") - 1), lambda e: F.struct(e.alias("epoch"), shard(e).alias("shard"))))
    none = F.array().cast("array<struct<epoch:int,shard:int>>")
    part = F.when(extra, F.array(F.struct(F.col("_whole").alias("epoch"), shard(F.lit(-1)).alias("shard")))).otherwise(none)
    copies = F.when(F.col("_size") > 0, F.concat(F.coalesce(whole.cast("array<struct<epoch:int,shard:int>>"), none), part)).otherwise(none)
    return out.select("_row", "_size", "_source_size", "_target", copies.alias("_copies"))


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mixed rows themselves: docs' columns, a row each time one is taken, dealt out by shard and shuffled locally."""
    taken = mix_plan(docs, params).withColumn("_copy", F.explode("_copies"))
    keyed = taken.withColumn("_shard", F.col("_copy.shard")).withColumn("_place", draw_key(params, "_copy.epoch", F.col("_row.doc_id").cast("long"), F.col("_size"), F.lit("place")))
    part = F.pmod(F.col("_place"), F.lit(1024))  # a shard is written by several tasks where it is large
    return keyed.repartition("_shard", part).sortWithinPartitions("_shard", "_place").select("_row.*")
