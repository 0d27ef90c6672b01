"""The most similar vectors of every vector (problem 2): vantage-point trees per shard.

Equal vectors are one class. Classes are spread over shards by their nearest pivot; pivots
are fitted on a bounded sample, every class is indexed. A class first searches its own
shard, which bounds the distance to its k-th neighbour, and then those shards that are not
farther than this distance multiplied by ``factor``: a shard begins at the plane half way
between its pivot and that of the query. Within a shard a vantage-point tree is pruned by
the triangle inequality, with the same factor. Factor 1 is exact search.

A shard of more than ``block_rows`` classes is cut into cells by pivots of its own, which
are chosen among its classes and kept as a table, and a query visits the cells of a shard
by the same rule; so a search stays as large as a cell whatever the number of vectors.
Cells that are still large are sliced by hash. Cells of near pivots are packed into blocks
of about ``HELD`` classes: a task holds one block, and a query travels to a block once,
with the cells it visits there; queries are never held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.llm.vp_tree import VPTree, distances
from mnemograph.session import cut, shuffle_partitions, unpriced

#: pivots of the first level, which every task holds, and vectors for each that they are fitted on
MAX_PIVOTS = 1024
SAMPLE_PER_PIVOT = 24
#: numbers of cells in a shard fit below this
CELLS = 1 << 24
#: most cells whose row counts, two numbers each, are sent to every task
CELLS_SENT = 1 << 18
#: classes that a task holds, queries that pass by it at most, that are read at once, and that are searched or routed at once
HELD, PASSING, READ_AT_ONCE, ROUTED_AT_ONCE = 64_000, 256_000, 10_000, 2_000
_FOUND = "class_id string, other_id string, dot double"


def usable(vector: Column, dimensions: int) -> Column:
    """Exactly ``dimensions`` finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True) if len(v) else v.reshape(0, 1)


def _pivots(classes: DataFrame, n: int, shard_rows: int, most: int) -> np.ndarray:
    """Centres of a spherical k-means on a sample of at most ``most`` * SAMPLE_PER_PIVOT rows."""
    count = int(min(most, max(1, n // shard_rows)))
    sample = classes.select("vec").orderBy(F.xxhash64("class_id"), "class_id").limit(count * SAMPLE_PER_PIVOT).toPandas()
    points = _unit(sample.vec)
    centres = points[:count].copy()
    for _ in range(6):
        nearest = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _in_order(pivots: np.ndarray, rows: np.ndarray) -> list[int]:
    """The rows so that near pivots follow one another: halved along their widest spread, again and again."""
    if len(rows) < 3:
        return rows.tolist()
    away = pivots[rows] - pivots[rows].mean(axis=0)
    order = rows[np.argsort(away @ np.linalg.svd(away, full_matrices=False)[2][0], kind="stable")]
    return _in_order(pivots, order[: len(rows) // 2]) + _in_order(pivots, order[len(rows) // 2 :])


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normed(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class _Block:
    """The classes of neighbouring cells, in the order of cells and ids, and a tree for each cell that is visited."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.vectors = np.concatenate([_matrix(b.column("vec")) for b in parts])
        self.ids = pa.concat_arrays([b.column("class_id") for b in parts])
        cell = np.concatenate([b.column("cell").to_numpy() for b in parts])
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.rows = {int(c): (int(low), int(high)) for c, low, high in zip(cell[first], first, np.append(first[1:], len(cell)))}
        self.trees: dict[int, VPTree] = {}

    def search(self, queries: pa.RecordBatch, k: int, factor: float) -> Iterator[pa.RecordBatch]:
        """Up to k nearest classes of each query in each of the cells that it names."""
        units, reach = _normed(_matrix(queries.column("vec"))), queries.column("reach").to_numpy().copy()
        own = pc.fill_null(pc.index_in(queries.column("class_id"), value_set=self.ids), -1).to_numpy().astype(np.int64)
        cells = queries.column("cells")
        wanted, of = cells.flatten().to_numpy(), np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy())
        order = np.argsort(wanted, kind="stable")
        wanted, of = wanted[order], of[order]
        first = np.flatnonzero(np.append(True, wanted[1:] != wanted[:-1])) if len(wanted) else []
        pieces = [(at, min(at + ROUTED_AT_ONCE, high)) for low, high in zip(first, [*first[1:], len(wanted)]) for at in range(low, high, ROUTED_AT_ONCE)]
        for low, high in pieces:
            cell, q = int(wanted[low]), of[low:high]
            if cell not in self.rows:
                continue
            start, end = self.rows[cell]
            if cell not in self.trees:
                self.trees[cell] = VPTree(self.vectors[start:end])
            best, dots = self.trees[cell].search(units[q], np.where((own[q] >= start) & (own[q] < end), own[q] - start, -1), k, reach[q], factor)
            full = best[:, -1] >= 0
            reach[q[full]] = np.minimum(reach[q[full]], distances(dots[full, -1]))
            row, slot = np.nonzero(best >= 0)
            yield pa.RecordBatch.from_arrays(
                [queries.column("class_id").take(pa.array(q[row])), self.ids.take(pa.array(best[row, slot] + start)), pa.array(dots[row, slot])],
                names=["class_id", "other_id", "dot"],
            )


def _streamed(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """Rows in the order of tasks, in each the index (kind 0), which is held, before its queries, which pass by."""
    at, parts, block = None, [], None
    for batch in batches:
        task, kind = batch.column("task").to_numpy(), batch.column("kind").to_numpy()
        change = np.flatnonzero((task[1:] != task[:-1]) | (kind[1:] != kind[:-1])) + 1
        for low, high in zip([0, *change], [*change, batch.num_rows]):
            if low == high:
                continue
            if task[low] != at:
                at, parts, block = task[low], [], None
            if kind[low] == 0:
                parts.append(batch.slice(low, high - low))
                continue
            if block is None:
                block, parts = _Block(parts), []
            for start in range(low, high, READ_AT_ONCE):
                yield from block.search(batch.slice(start, min(READ_AT_ONCE, high - start)), k, factor)


def _pivots_of_shards(placed: DataFrame, sizes: DataFrame, block_rows: int) -> DataFrame:
    """(shard, block, pivot): of each large shard one class in ``block_rows``, by hash, numbered from 0."""
    wanted = sizes.where(F.col("n") > block_rows).withColumn("pivots", F.ceil(F.col("n") / block_rows))
    few = placed.join(F.broadcast(wanted), "shard")  # at most MAX_PIVOTS rows
    drawn = few.where(F.pmod(F.xxhash64("class_id", F.lit(7)), F.col("n")) < 2 * F.col("pivots") + 8)
    order = Window.partitionBy("shard").orderBy(F.xxhash64("class_id", F.lit(11)), "class_id")
    return drawn.withColumn("block", F.row_number().over(order) - 1).where(F.col("block") < F.col("pivots")).select("shard", "block", F.col("vec").alias("pivot"))


def nearest_classes(classes: DataFrame, k: int, factor: float, min_dot: float = -1.0, shard_rows: int = 2000, block_rows: int = 16_000, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(class_id, other_id, dot): up to k nearest other classes with a dot product of ``min_dot`` or more."""
    spark = classes.sparkSession
    n = classes.count()
    if n < 2:
        return spark.createDataFrame([], _FOUND)
    centres = _pivots(classes, n, shard_rows, max_pivots)
    shared = spark.sparkContext.broadcast((centres, np.maximum(distances(centres @ centres.T), 1e-9)))
    farthest = float(distances(np.array(min_dot)))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = [np.empty(0, np.int32)]
            for low in range(0, batch.num_rows, ROUTED_AT_ONCE):
                units = _normed(_matrix(batch.column("vec").slice(low, ROUTED_AT_ONCE)))
                nearest.append(np.argmax(units @ shared.value[0].T, axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(nearest))], names=["class_id", "vec", "shard"])

    routed = cut(classes.select("class_id", "vec").mapInArrow(home, "class_id string, vec array<float>, shard int"))
    sizes = routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    large = frozenset(r.shard for r in sizes.where(F.col("n") > block_rows).select("shard").collect())  # at most MAX_PIVOTS
    has_large = bool(large)
    is_large = F.array_contains(F.lit(sorted(large)).cast("array<int>"), F.col("shard"))
    pivots = cut(_pivots_of_shards(routed, sizes, block_rows)) if has_large else None

    def to_cells(rows: DataFrame, schema: str, go) -> DataFrame:
        """``rows`` (with shard and vec), all of large shards, with the ``cell`` of each, or all cells of its shard that ``go`` says.

        ``go(rows, dot products with the shard's pivots, distances between those)`` is a mask of rows x pivots.
        """
        names = [c.split()[0] for c in schema.split(", ")]
        chunks = F.broadcast(rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("chunks")))  # at most MAX_PIVOTS rows
        chunked = rows.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("class_id"), F.col("chunks").cast("bigint")).cast("int")).drop("chunks")
        spread = pivots.join(chunks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", "pivot")
        spread = spread.toDF(*spread.columns)  # new column ids: both sides come from the same table

        def choose(mine: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(mine):
                return pd.DataFrame({c: [] for c in [*names, "cells"]})
            units, cells = _unit(own["pivot"]), own.block.to_numpy(np.int64) + int(mine.shard.iloc[0]) * CELLS
            apart = np.maximum(distances(units @ units.T), 1e-9)
            found: list[np.ndarray] = []
            for low in range(0, len(mine), ROUTED_AT_ONCE):
                some = mine.iloc[low : low + ROUTED_AT_ONCE]
                found += [cells[mask] for mask in go(some, _unit(some.vec) @ units.T, apart)]
            return mine[names].assign(cells=found)

        out = chunked.groupBy("shard", "chunk").cogroup(spread.groupBy("shard", "chunk")).applyInPandas(choose, schema + ", cells array<bigint>")
        return out.select(*names, F.explode("cells").alias("cell"))

    def nearest_only(_: pd.DataFrame, dots: np.ndarray, apart: np.ndarray) -> np.ndarray:
        mask = np.zeros(dots.shape, bool)
        mask[np.arange(len(dots)), dots.argmax(axis=1)] = True
        return mask

    placed = routed.where(~is_large).withColumn("cell", F.col("shard").cast("bigint") * CELLS)
    if has_large:
        placed = cut(placed.unionByName(to_cells(routed.where(is_large), "class_id string, vec array<float>, shard int", nearest_only)))
    # slices of cells, those of near pivots side by side, are packed into blocks that a task can hold
    ranks = spark.createDataFrame(list(zip(_in_order(centres, np.arange(len(centres))), range(len(centres)))), "shard int, rank int")
    held = int(min(HELD, max(shard_rows, n // 4)))
    slices = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / (2 * block_rows)).cast("int"))
    slices = slices.join(F.broadcast(ranks), "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    before = F.sum(F.ceil(F.col("n") / F.col("parts"))).over(Window.orderBy("rank", "cell", "slice").rowsBetween(Window.unboundedPreceding, -1))  # a row for each slice
    units = cut(slices.select("shard", "cell", "slice", "parts", F.floor(F.coalesce(before, F.lit(0)) / held).cast("int").alias("block")))
    few = units.count() <= CELLS_SENT  # else the cells' numbers are joined like any other table
    of_cells = F.broadcast(units.drop("shard")) if few else units.drop("shard")
    block_of = np.full(len(centres), -1, np.int64)
    for r in units.where(~is_large).collect():  # at most MAX_PIVOTS
        block_of[r.shard] = r.block
    by_block = np.flatnonzero(block_of >= 0)
    by_block = by_block[np.argsort(block_of[by_block], kind="stable")]  # of whole shards, in the order of their blocks
    index = placed.withColumnRenamed("cell", "of_cell").join(of_cells.withColumnRenamed("cell", "of_cell"), "of_cell").where(F.pmod(F.xxhash64("class_id"), F.col("parts").cast("bigint")) == F.col("slice"))
    index = index.select("block", F.col("of_cell").alias("cell"), "class_id", "vec")
    least_tasks = shuffle_partitions(spark)

    def matched(queries: DataFrame) -> DataFrame:
        """Every query (block, class_id, vec, reach, cells) against its cells in the block.

        A task holds one block and lets the queries pass by; a block with many queries is
        held by several tasks, each of which has a part of them.
        """
        counts = {r.block: r["count"] for r in queries.groupBy("block").count().collect()}  # a row for each block
        if not counts:
            return spark.createDataFrame([], _FOUND)
        a_task = min(PASSING, max(1, sum(counts.values()) // least_tasks))
        rows, first = [], 0
        for block, count in sorted(counts.items()):
            rows.append((block, first, -(-count // a_task)))
            first += rows[-1][2]
        tasks = F.broadcast(spark.createDataFrame(rows, "block int, first int, parts int"))
        none = {"reach": F.lit(None).cast("double"), "cells": F.lit(None).cast("array<bigint>")}
        i = index.join(tasks, "block").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("task"), F.lit(0).alias("kind"), "cell", "class_id", "vec")
        q = queries.join(tasks, "block").select((F.col("first") + F.pmod(F.xxhash64("class_id"), F.col("parts").cast("bigint")).cast("int")).alias("task"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("cell"), "class_id", "vec", "reach", "cells")
        both = i.withColumns(none).unionByName(q).repartitionById(first, F.col("task")).sortWithinPartitions("task", "kind", "cell", "class_id")
        return both.mapInArrow(lambda batches: _streamed(batches, k, factor), _FOUND)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("class_id").orderBy(F.desc("dot"), "other_id")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")

    to_home = placed.join(of_cells, "cell").select("block", "class_id", "vec", F.lit(farthest).alias("reach"), F.array("cell").alias("cells"))
    first = cut(best(matched(to_home)))
    kth = first.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.min("dot").alias("least")).where(F.col("n") >= k)
    to_kth = F.least(F.lit(farthest), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))))
    reach = F.when(F.col("least").isNull(), F.lit(farthest)).otherwise(to_kth)  # fewer than k so far: the whole radius
    bounded = placed.join(unpriced(kth), "class_id", "left").select("class_id", "vec", F.col("shard").alias("home"), F.col("cell").alias("home_cell"), reach.alias("reach"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards of each query: x of a shard lies nearer to its pivot than to the
        query's, so it is at least as far as the plane half way between both. The query's
        own shard is visited again only for its other cells. A query is one row, with its
        whole shards by block and its large shards."""
        centres, apart = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, ROUTED_AT_ONCE):
                batch = whole.slice(low, ROUTED_AT_ONCE)
                dots = _normed(_matrix(batch.column("vec"))) @ centres.T
                mine, at = batch.column("home").to_numpy(), np.arange(batch.num_rows)
                go = (dots[at, mine][:, None] - dots) / apart[mine] <= factor * batch.column("reach").to_numpy()[:, None] + 1e-9
                go[at, mine] = True
                q, shard = np.nonzero(go[:, sorted(large)])
                to_large = pa.ListArray.from_arrays(pa.array(np.searchsorted(q, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(np.array(sorted(large), np.int32)[shard]))
                go[at, mine] = False
                q, shard = np.nonzero(go[:, by_block])
                shard = by_block[shard]
                change = np.append(True, (q[1:] != q[:-1]) | (block_of[shard[1:]] != block_of[shard[:-1]]))
                start = np.flatnonzero(change[: len(q)])
                cells = pa.ListArray.from_arrays(pa.array(np.append(start, len(q)).astype(np.int32)), pa.array(shard * CELLS))
                stops = pa.StructArray.from_arrays([pa.array(block_of[shard[start]].astype(np.int32)), cells], names=["block", "cells"])
                stops = pa.ListArray.from_arrays(pa.array(np.searchsorted(q[start], np.arange(batch.num_rows + 1)).astype(np.int32)), stops)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class_id", "vec", "reach", "home_cell")), stops, to_large], names=["class_id", "vec", "reach", "home_cell", "stops", "large"])

    def near_cells(rows: pd.DataFrame, dots: np.ndarray, apart: np.ndarray) -> np.ndarray:
        nearest = dots.argmax(axis=1)
        return (dots[np.arange(len(dots)), nearest][:, None] - dots) / apart[nearest] <= factor * rows.reach.to_numpy()[:, None] + 1e-9

    visits = cut(bounded.mapInArrow(visit, "class_id string, vec array<float>, reach double, home_cell bigint, stops array<struct<block int, cells array<bigint>>>, large array<int>"))
    away = visits.select("class_id", "vec", "reach", F.explode("stops").alias("s")).select("s.block", "class_id", "vec", "reach", "s.cells")
    if has_large:
        queries = visits.select("class_id", "vec", "reach", "home_cell", F.explode("large").alias("shard"))
        cells = to_cells(queries, "class_id string, vec array<float>, reach double, home_cell bigint", near_cells).where("cell <> home_cell")
        cells = cut(cells.join(of_cells, "cell").select("block", "class_id", "vec", "reach", F.array("cell").alias("cells")))
        away = away.unionByName(cells)
    return best(first.unionByName(matched(away)))


def similar_events(
    events: DataFrame, field: str, k: int = 5, min_score: float = 0.0, factor: float = 0.35, dimensions: int = 128, shard_rows: int = 2000, block_rows: int = 16_000, max_pivots: int = MAX_PIVOTS
) -> DataFrame:
    """(vector_field, event_id, place, other_id, score): the k most similar usable events.

    The score is (1 + cosine) / 2; ``min_score`` leaves out less similar ones. An event
    counts once, in its latest delivery; deleted events and vectors that are null, of
    another length, not finite or all zero are left out. The event itself is left out,
    equal scores go by smaller ``event_id``. Of equal vectors only one is searched for.
    A table with fewer than two usable events gives no row.
    """
    latest = events.where("event_id is not null").groupBy("event_id").agg(F.max_by(F.struct(F.col(field).alias("vec"), F.coalesce("is_delete", F.lit(False)).alias("gone")), F.coalesce("created_time", F.lit("1000-01-01").cast("timestamp_ntz"))).alias("e"))
    kept = latest.where(~F.col("e.gone") & usable(F.col("e.vec"), dimensions)).select("event_id", F.col("e.vec").cast("array<float>").alias("vec"))
    # equal vectors meet by 128 bits of hash; of a class only the first k + 1 events are ever ranked
    hashed = cut(kept.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}))
    keys = ["h1", "h2"]
    named = hashed.groupBy(*keys).agg(F.min("event_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    members = cut(hashed.select("event_id", *keys).join(unpriced(named), keys).select("event_id", "class_id", "copies"))
    classes = hashed.join(unpriced(members.where("event_id = class_id").select("event_id")), "event_id", "left_semi").select(F.col("event_id").alias("class_id"), "vec")
    near = nearest_classes(classes, k, factor, 2 * min_score - 1, shard_rows, block_rows, max_pivots)
    inside = Window.partitionBy("class_id").orderBy("event_id")
    first = members.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= k + 1).select("class_id", F.col("event_id").alias("other_id"), "copies")
    others = near.select("class_id", F.col("other_id").alias("other_class"), F.col("dot")).join(unpriced(first.withColumnRenamed("class_id", "other_class")), "other_class").select("class_id", "other_id", "dot")
    equal = first.where("copies > 1").select("class_id", "other_id", F.lit(1.0).alias("dot"))
    by_class = Window.partitionBy("class_id").orderBy(F.desc("dot"), "other_id")
    candidates = others.unionByName(equal).withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k + 1).drop("place")
    joined = members.select("event_id", "class_id").join(unpriced(candidates), "class_id").where(F.col("event_id") != F.col("other_id"))
    by_event = Window.partitionBy("event_id").orderBy(F.desc("dot"), "other_id")
    out = joined.withColumn("place", F.row_number().over(by_event)).where(F.col("place") <= k)
    score = (1 + F.col("dot")) / 2
    return out.select(F.lit(field).alias("vector_field"), "event_id", "place", "other_id", score.alias("score")).where(score >= min_score - 1e-12)


def similar_pairs(events: DataFrame, fields: tuple[str, ...], k: int, min_score: float, **options) -> DataFrame:
    """(vector_field, event_id_a, event_id_b): pairs of which one is among the other's k nearest."""
    out = None
    for field in fields:
        near = similar_events(events, field, k, min_score, **options)
        pairs = near.select("vector_field", F.least("event_id", "other_id").alias("event_id_a"), F.greatest("event_id", "other_id").alias("event_id_b")).distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out
