"""The index: lists of codes and exact records, with batched insert, delete and search."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodevec.operators import quantizer, router, search
from lodevec.plans.config import MAX_ID, IndexConfig, SearchParams, need
from lodevec.sources.store import FILE, PART, Store, manifest_of, manifest_text


def dense_positions(rows: DataFrame, order: str, count: int | None = None) -> DataFrame:
    """rows with _pos, 0 to n - 1 by an order column (unique): counted in ranges of it, then offset by a small table of
    their sizes, so no task sees all rows. The ranges' bounds are read once from a sample: a row's range follows from its
    value alone, and not from how a plan deals out or coalesces its partitions. count: the number of rows, if known."""
    parts, each = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 50
    share = min(1.0, parts * each / max(rows.count() if count is None else count, 1))
    sample = sorted(r[0] for r in rows.select(order).sample(share, 11).where(F.col(order).isNotNull()).collect())
    bounds = F.array(*map(F.lit, sample[each::each])).cast(f"array<{rows.schema[order].dataType.simpleString()}>")
    ranged = rows.withColumn("_part", F.size(F.filter(bounds, lambda x: x < F.col(order))))
    ranked = ranged.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(order)))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    return ranked.join(F.broadcast(starts), "_part").withColumn("_pos", F.col("_start") + F.col("_rank") - 1).drop("_part", "_rank", "_start")


def append_offsets(assigned: DataFrame, sizes: DataFrame) -> DataFrame:
    """assigned (id, list_no, ...) with offset: the list's size so far plus the row's rank by id in the batch. Rows are
    ranked in runs of ids and the runs' sizes summed up, so that no task sees all rows of a long list."""
    runs = assigned.withColumn("_run", F.floor(F.col("id") / FILE))
    counts = runs.groupBy("list_no", "_run").agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy("list_no").orderBy("_run")
    starts = counts.join(sizes, "list_no", "left").select("list_no", "_run", (F.coalesce("size", F.lit(0)) + F.sum("_n").over(order) - F.col("_n")).alias("_start"))
    ranked = runs.withColumn("_rank", F.row_number().over(W.partitionBy("list_no", "_run").orderBy("id")))
    return ranked.join(starts, ["list_no", "_run"]).withColumn("offset", (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_rank", "_run", "_start")


def append_pages(sizes: DataFrame, per_page: int) -> DataFrame:
    """(list_no, pages_read, pages_written) of an append, from (list_no, old, added): a page that is filled in part is
    read and written again. Lists without new rows get no row."""
    again = F.when(F.col("old") % per_page != 0, 1).otherwise(0)
    more = F.ceil((F.col("old") + F.col("added")) / per_page) - F.ceil(F.col("old") / per_page)
    return sizes.where("added > 0").select("list_no", again.cast("long").alias("pages_read"), (more + again).cast("long").alias("pages_written"))


def swap_plan(deleted: DataFrame, rows: DataFrame) -> DataFrame:
    """(list_no, id, from_offset, to_offset): which rows move so that lists stay dense. deleted and rows: (list_no,
    offset, id). The holes below the new size, upwards, take the surviving rows above it, downwards."""
    counts = rows.groupBy("list_no").agg(F.count(F.lit(1)).alias("n")).join(deleted.groupBy("list_no").agg(F.count(F.lit(1)).alias("k")), "list_no").select("list_no", (F.col("n") - F.col("k")).alias("left"))
    holes = deleted.join(counts, "list_no").where("offset < left").withColumn("i", F.row_number().over(W.partitionBy("list_no").orderBy("offset"))).select("list_no", "i", F.col("offset").alias("to_offset"))
    tail = rows.join(counts, "list_no").where("offset >= left").join(deleted.select("list_no", "offset"), ["list_no", "offset"], "left_anti")
    sources = tail.withColumn("i", F.row_number().over(W.partitionBy("list_no").orderBy(F.desc("offset")))).select("list_no", "i", "id", F.col("offset").alias("from_offset"))
    return holes.join(sources, ["list_no", "i"]).select("list_no", "id", "from_offset", "to_offset")


def delete_pages(deleted: DataFrame, moves: DataFrame, sizes: DataFrame, per_page: int) -> DataFrame:
    """(list_no, deleted, moved, pages_read, pages_written) of a delete. deleted: (list_no, offset); moves: (list_no,
    from_offset, to_offset); sizes: (list_no, size) before it.

    Read are the pages of deleted rows, of both ends of moves and the page that becomes the last one unless it is full;
    written those where rows move to, and that last page, as its end is cleared. Lists without a deleted row get no row.
    """
    page = lambda c: F.floor(F.col(c) / per_page).cast("long").alias("page")
    counts = deleted.groupBy("list_no").agg(F.count(F.lit(1)).alias("deleted"))
    after = counts.join(sizes, "list_no").withColumn("left", F.col("size") - F.col("deleted"))
    last = after.where(F.col("left") % per_page != 0).select("list_no", page("left"))
    writes = moves.select("list_no", page("to_offset")).union(last).distinct()
    reads = writes.union(moves.select("list_no", page("from_offset"))).union(deleted.select("list_no", page("offset"))).distinct()
    number = lambda frame, name: frame.groupBy("list_no").agg(F.count(F.lit(1)).alias(name))
    out = counts.join(number(moves, "moved"), "list_no", "left").join(number(reads, "pages_read"), "list_no", "left").join(number(writes, "pages_written"), "list_no", "left")
    return out.na.fill(0).select("list_no", "deleted", "moved", "pages_read", "pages_written")


class VectorIndex:
    """One index in a folder. Changes are made by one process at a time; readers keep the generation they opened."""

    def __init__(self, store: Store, config: IndexConfig, model: quantizer.Quantizer | None, centroids: np.ndarray | None, manifest: dict):
        self.store, self.config, self.model, self.centroids, self.manifest = store, config, model, centroids, manifest

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    @staticmethod
    def create(spark: SparkSession, root: str, config: IndexConfig) -> VectorIndex:
        """An empty index; the folder must not hold one."""
        store = Store(spark, root)
        need(store.read_text("manifest.json") is None, "an index is here already")
        return VectorIndex(store, config, None, None, {"version": 2, "generation": 0, "next_id": 0, "lists": {}, "parts": {}, "sizes": {}})

    @staticmethod
    def open(spark: SparkSession, root: str) -> VectorIndex:
        """The index as of its last checkpoint, checked against its files."""
        store = Store(spark, root)
        manifest = manifest_of(store.read_text("manifest.json"))
        model = quantizer.Quantizer.from_json(store.read_text("quantizer.json") or "")
        centroids = np.array(json.loads(store.read_text("centroids.json") or "null"), float)
        need(centroids.shape == (model.config.nlist, model.config.dimension), "the saved router has another shape")
        index = VectorIndex(store, model.config, model, centroids, manifest)
        for table in ("postings", "records"):
            counts = {r.list_no: r.n for r in store.read(table, manifest["lists"]).groupBy("list_no").agg(F.count(F.lit(1)).alias("n")).collect()}
            need(counts == {k: n for k, n in manifest["sizes"].items() if n}, f"{table} don't match the manifest")
        need(index.locations().count() == index.size(), "the directory doesn't match the manifest")
        return index

    def fit(self, vectors: DataFrame, model: quantizer.Quantizer | None = None) -> VectorIndex:
        """Learn router and quantizer from (id, embedding); only while the index is new. model: one trained before."""
        need(self.model is None and not self.manifest["lists"], "the index is trained already")
        need(model is None or model.config == self.config, "the quantizer has another configuration")
        self.centroids = router.train_centroids(vectors, self.config)
        self.model = model or quantizer.train(vectors, self.config)
        self.store.write_text("quantizer.json", self.model.to_json())
        self.store.write_text("centroids.json", json.dumps(self.centroids.tolist()))
        return self

    def sizes(self) -> DataFrame:
        return self.spark.createDataFrame([(k, n) for k, n in sorted(self.manifest["sizes"].items())] or [], "list_no int, size long")

    def size(self) -> int:
        return sum(self.manifest["sizes"].values())

    def next_id(self) -> int:
        return self.manifest["next_id"]

    def list_size(self, list_no: int) -> int:
        need(0 <= list_no < self.config.nlist, "no such list")
        return self.manifest["sizes"].get(list_no, 0)

    def centroid(self, list_no: int) -> np.ndarray:
        need(0 <= list_no < self.config.nlist, "no such list")
        return self.centroids[list_no]

    def postings(self, lists: list[int] | None = None) -> DataFrame:
        return self.store.read("postings", self._gens(lists))

    def records(self, lists: list[int] | None = None) -> DataFrame:
        return self.store.read("records", self._gens(lists))

    def locations(self, parts: list[int] | None = None) -> DataFrame:
        """(id, list_no, offset) of all rows there are, from the directory."""
        held = {k: v for k, v in self.manifest["parts"].items() if parts is None or k in parts}
        return self.store.read("locations", held).select("id", "list_no", "offset")

    def _parts_of(self, ids: DataFrame) -> list[int]:
        """Parts of the directory that hold ids (id); at most as many as there are parts."""
        return [r.part for r in ids.select(F.floor(F.col("id") / PART).cast("int").alias("part")).where("part is not null").distinct().collect()]

    def locate(self, ids: DataFrame) -> DataFrame:
        """ids (id) with list_no and offset, null where deleted; an id that was never given fails. Only the parts of the
        directory that hold an id are read."""
        wanted = ids.select(F.col("id").cast("long").alias("id"))
        found = wanted.join(self.locations(self._parts_of(wanted)), "id", "left")
        known = (F.col("id") >= 0) & (F.col("id") < self.next_id())
        return found.withColumn("id", F.when(known, F.col("id")).otherwise(F.raise_error(F.lit("unknown id")).cast("long")))

    def ids_at(self, places: DataFrame) -> DataFrame:
        """places (list_no, offset) with the id there; a place that no row has fails."""
        lists = [r.list_no for r in places.select("list_no").distinct().collect()]
        found = places.join(self.records(lists).select("list_no", "offset", "id"), ["list_no", "offset"], "left")
        return found.withColumn("id", F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.lit("no such offset")).cast("long")))

    def _gens(self, lists: list[int] | None) -> dict[int, list[int]]:
        return {k: v for k, v in self.manifest["lists"].items() if v and (lists is None or k in lists)}

    def insert(self, vectors: DataFrame, order: str = "id", payload: str = "embedding") -> int:
        """Append a batch; new ids are dense, in the order of a unique column. Returns the number of rows."""
        need(self.model is not None, "the index isn't trained")
        count, distinct, nulls = vectors.agg(F.count(F.lit(1)), F.count_distinct(order), F.sum(F.col(order).isNull().cast("int"))).first()
        if not count:
            return 0
        need(count == distinct and not nulls, "the order column must be unique and not null")
        need(self.next_id() + count <= MAX_ID, "ids are used up")
        gen = self.manifest["generation"] + 1
        columns = list(dict.fromkeys([order, "embedding", payload]))
        placed = dense_positions(vectors.select(*columns), order).withColumn("_id", F.col("_pos") + self.next_id())
        batch = placed.select(F.col("_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col(payload).cast("array<float>").alias("payload"))
        stage = f"{self.store.root}/stage/gen={gen}"
        batch.write.mode("overwrite").parquet(f"{stage}/batch")  # ids are given once, and so are places
        coded = quantizer.encode(router.assign(self.spark.read.schema(batch.schema).parquet(f"{stage}/batch"), self.centroids), self.model)
        placed = append_offsets(coded, self.sizes()).drop("embedding")
        placed.write.mode("overwrite").parquet(f"{stage}/placed")
        rows = self.spark.read.schema(placed.schema).parquet(f"{stage}/placed")
        added = {r.list_no: r.n for r in rows.groupBy("list_no").agg(F.count(F.lit(1)).alias("n")).collect()}
        need(sum(added.values()) == count, "rows were lost on the way")
        self.store.write("postings", gen, rows.select("list_no", "offset", "code", "norm_c", "scale_c", "err_c"))
        per_page = self.config.records_per_page
        self.store.write("records", gen, rows.select("list_no", "offset", F.floor(F.col("offset") / per_page).alias("page_no"), "id", "payload"))
        self.store.write("locations", gen, rows.select(F.floor(F.col("id") / PART).cast("int").alias("part"), "id", "list_no", "offset"))
        lists = {k: [*self.manifest["lists"].get(k, []), *([gen] if k in added else [])] for k in {*self.manifest["lists"], *added}}
        new = range(self.next_id() // PART, (self.next_id() + count - 1) // PART + 1)
        parts = {k: [*self.manifest["parts"].get(k, []), *([gen] if k in new else [])] for k in {*self.manifest["parts"], *new}}
        sizes = {k: self.manifest["sizes"].get(k, 0) + added.get(k, 0) for k in {*self.manifest["sizes"], *added}}
        self.store.fs.delete(self.store.path(f"{self.store.root}/stage"), True)
        self.manifest = self.manifest | {"generation": gen, "next_id": self.next_id() + count, "lists": lists, "parts": parts, "sizes": sizes}
        return count

    def erase(self, ids: DataFrame) -> int:
        """Delete rows by id; all of them or, if an id is unknown, deleted or named twice, none. Returns their number.
        Only the lists that hold one are written anew."""
        wanted = ids.select(F.col("id").cast("long").alias("id"))
        count, distinct = wanted.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
        if not count:
            return 0
        need(count == distinct, "an id is null or named twice")
        need(count <= self.size(), "more ids than rows")
        deleted = self.locations(self._parts_of(wanted)).join(wanted, "id")
        hit = {r.list_no: r.n for r in deleted.groupBy("list_no").agg(F.count(F.lit(1)).alias("n")).collect()}
        need(sum(hit.values()) == count, "an id is unknown or deleted")
        gen = self.manifest["generation"] + 1
        old = self.records(list(hit))
        rows = old.select("list_no", "offset", "id")
        moves = swap_plan(deleted.select("list_no", "offset", "id"), rows)
        # Directory and records must agree on what goes and what moves, before anything is written.
        places = deleted.select("list_no", "offset", "id").unionByName(moves.select("list_no", F.col("from_offset").alias("offset"), "id"))
        need(places.join(rows, ["list_no", "offset", "id"], "left_anti").isEmpty(), "the directory disagrees with the records")
        touched = self._parts_of(places)
        held = self.locations(touched)
        need(places.join(held, ["list_no", "offset", "id"], "left_anti").isEmpty(), "the directory disagrees with a moved row")
        gone, to = deleted.select("list_no", "offset"), moves.select("list_no", F.col("from_offset").alias("offset"), "to_offset")
        keep = lambda table: table.join(gone, ["list_no", "offset"], "left_anti").join(to, ["list_no", "offset"], "left").withColumn("offset", F.coalesce("to_offset", "offset")).drop("to_offset")
        self.store.write("postings", gen, keep(self.postings(list(hit))))
        self.store.write("records", gen, keep(old).withColumn("page_no", F.floor(F.col("offset") / self.config.records_per_page)))
        stay = held.join(wanted, "id", "left_anti").join(moves.select("id", "to_offset"), "id", "left").withColumn("offset", F.coalesce("to_offset", "offset"))
        self.store.write("locations", gen, stay.select(F.floor(F.col("id") / PART).cast("int").alias("part"), "id", "list_no", "offset"))
        sizes = {k: n - hit.get(k, 0) for k, n in self.manifest["sizes"].items()}
        lists = {k: ([gen] if sizes[k] else []) if k in hit else v for k, v in self.manifest["lists"].items()}
        parts = {k: [gen] if k in touched else v for k, v in self.manifest["parts"].items()}
        self.manifest = self.manifest | {"generation": gen, "lists": lists, "parts": parts, "sizes": sizes}
        return count

    def erase_stats(self, ids: DataFrame) -> DataFrame:
        """(list_no, deleted, moved, pages_read, pages_written) that erasing ids would take; nothing is changed."""
        wanted = ids.select(F.col("id").cast("long").alias("id"))
        deleted = self.locations(self._parts_of(wanted)).join(wanted, "id").select("list_no", "offset", "id")
        lists = [r.list_no for r in deleted.select("list_no").distinct().collect()]
        return delete_pages(deleted, swap_plan(deleted, self.records(lists).select("list_no", "offset", "id")), self.sizes(), self.config.records_per_page)

    def checkpoint(self) -> None:
        """Publish the present state: the manifest comes last; generations that no list needs are deleted after it."""
        self.store.write_text("manifest.json", manifest_text(self.manifest))
        self.store.drop_unused({g for name in ("lists", "parts") for gens in self.manifest[name].values() for g in gens})

    def search(self, queries: DataFrame, params: SearchParams = SearchParams(), exact=None) -> DataFrame:
        """(qid, rank, id, distance) of queries (qid, qv)."""
        out = None
        for _, candidates, block_queries, lists in self._selected(queries, params):
            part = search.refine(candidates, self.records(lists), block_queries, params, self.config.metric, exact)
            out = part if out is None else out.union(part)
        return self.spark.createDataFrame([], "qid long, rank int, id long, distance double") if out is None else out

    def search_stats(self, queries: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
        """(qid, probed_lists, scanned, padded, candidates, candidate_lists, pages, requests, requested_bytes,
        opened_files) of a search."""
        out = None
        for scanned, candidates, _, _ in self._selected(queries, params):
            found = candidates.groupBy("qid").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("list_no").alias("candidate_lists"))
            part = scanned.groupBy("qid").agg(F.count(F.lit(1)).alias("probed_lists"), F.sum("size").alias("scanned"), F.sum(F.ceil(F.col("size") / 32) * 32).alias("padded")).join(found, "qid", "left").join(search.read_plan(candidates, self.config.records_per_page), "qid", "left")
            part = part.withColumn("requested_bytes", F.col("pages") * self.config.page_bytes).withColumn("opened_files", F.col("candidate_lists"))
            out = part if out is None else out.union(part)
        return out

    def _selected(self, queries: DataFrame, params: SearchParams):
        """For each block of queries: the lists it probes, its candidates, itself and the list numbers."""
        need(self.model is not None, "the index isn't trained")
        need(self.size() >= params.k, "the index holds fewer rows than k")
        for block in search.query_blocks(queries, self.config.dimension, params.query_block):
            # At most query_block x nprobe rows: bounded, and known on the driver so that partitions can be pruned.
            near = router.nearest_lists(block.qv, self.centroids, params.nprobe)
            sizes, probes, scanned = self.manifest["sizes"], {}, []
            for i, lists in enumerate(near):
                begin, probes[i] = 0, {}
                for list_no in map(int, lists):
                    if n := sizes.get(list_no, 0):
                        probes[i][list_no] = begin
                        begin += n
                        scanned.append((int(block.qid[i]), list_no, n))
                need(begin >= params.k, "the probed lists hold fewer rows than k")
            lists = sorted({k for p in probes.values() for k in p})
            found = search._scan(self.postings(lists), self.model, block, probes, params)
            if not params.limit:  # all rows under theta: found in a second pass
                theta = {r.qid: r.theta for r in search.interval_select(found, params).groupBy("qid").agg(F.first("theta").alias("theta")).collect()}
                found = search._scan(self.postings(lists), self.model, block, probes, params, theta)
                candidates = found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("est", "token")))
            else:
                candidates = search.interval_select(found, params)
            block_queries = self.spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(block.qid, block.qv)], "qid long, qv array<double>")
            yield self.spark.createDataFrame(scanned, "qid long, list_no int, size long"), candidates, block_queries, lists
