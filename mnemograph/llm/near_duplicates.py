"""Near-duplicate records (problem 4): an exact set-similarity join by partition and pigeonhole.

The distinct word runs of a record are a set of hashes. For sets r and s with Jaccard
similarity of at least t the symmetric difference is at most
H = (1 - t) / (1 + t) * (|r| + |s|). The universe of hashes is cut into m segments, m set
by the size band of the smaller set. A probing set gives every segment a tolerance a of
0 (not looked up), 1 (equal segment) or 2 (equal up to one element, by one-deletion
neighbourhoods) with a total of at least H + 1: by the pigeonhole principle a partner
agrees within the tolerance in at least one segment. Among the allocations the cheapest is
taken, by a sketch of fixed size that counts how many indexed sets each signature would
reach. Candidates are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.operators.components import connected_components
from mnemograph.session import cut, unpriced

SKETCH_BITS = 19
_CHUNK = 4096
_OUTLINE = 256
#: records of a group that one salt of its pairs holds on average
PAIRED_IN_TASK = 1000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SIGNATURES = "sig bigint, id bigint, n int"


def word_runs(texts: list[Column], width: int) -> Column:
    """Sorted distinct hashes of every ``width`` consecutive words of the columns in order.

    A word is a run of letters or digits of the lower-cased text; a null text is empty.
    """
    joined = F.lower(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)))
    words = F.regexp_extract_all(joined, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))

    def runs(w: Column) -> Column:
        last = F.size(w) - width
        grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
        return F.when(last >= 0, F.array_sort(F.array_distinct(grams))).otherwise(F.array().cast("array<bigint>"))

    # bound to a one-element array, so that the words are extracted once for a row
    return F.element_at(F.transform(F.array(words), runs), 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    return (x ^ (x >> np.uint64(29))) * _ODD[1]


class Plan:
    """Size bands, their segment counts, and the difference two sizes allow."""

    def __init__(self, threshold: float, band_ratio: float = 1.3, segments: float = 0.8):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be in (0, 1]")
        self.threshold, self.band_ratio, self.segments = threshold, band_ratio, segments
        self.tops = [1]

    def reach(self, size: int) -> None:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * self.band_ratio)))

    def band(self, size: int) -> int:
        self.reach(size)
        return int(np.searchsorted(self.tops, size))

    def difference(self, band: int, size: int) -> int:
        """Most elements in which a set of ``size`` and a similar one of the band, not larger, differ."""
        t = self.threshold
        return int((1 - t) / (1 + t) * (min(self.tops[band], size) + size) + 1e-9)

    def count(self, band: int) -> int:
        """Segments of a band: room to leave out costly ones, and enough for every probe."""
        top = self.tops[band]
        largest = int(top / self.threshold) + 1
        return max(1, int(self.segments * (self.difference(band, top) + 1)), -(-(self.difference(band, largest) + 1) // 2))

    def probed(self, size: int) -> range:
        return range(self.band(max(1, int(np.ceil(self.threshold * size - 1e-9)))), self.band(size) + 1)


class Segments:
    """Signatures of many sets in one band, vectorised."""

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, n_sets: int, band: int, m: int):
        mixed = _mix(tokens)
        self.m = m
        segment = ((mixed >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        self.cell = owner * m + segment
        order = np.argsort(self.cell, kind="stable")
        self.cell, mixed = self.cell[order], mixed[order]
        total = np.zeros(n_sets * m, np.uint64)
        self.sizes = np.bincount(self.cell, minlength=n_sets * m)
        if len(self.cell):
            first = np.flatnonzero(np.append(True, self.cell[1:] != self.cell[:-1]))
            total[self.cell[first]] = np.add.reduceat(mixed, first)
        place = _mix(np.arange(m, dtype=np.uint64) + _ODD[2:3] * np.uint64(band))
        salt = np.tile(place, n_sets)
        self.full = _mix(total ^ salt)
        self.deleted = _mix((total[self.cell] - mixed) ^ salt[self.cell])


def _flat(sets: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in sets], np.int64)
    tokens = np.concatenate(list(sets)).astype(np.int64).view(np.uint64) if len(sets) else np.empty(0, np.uint64)
    return tokens, sizes


def _rows(sig: np.ndarray, deleted: bool, ids: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """The last bit of a signature says whether the indexed side has an element deleted."""
    sig = (sig & ~np.uint64(1)) | np.uint64(deleted)
    return pd.DataFrame({"sig": sig.view(np.int64), "id": ids, "n": sizes.astype(np.int32)})


def _index(batches: Iterator[pd.DataFrame], plan: Plan) -> Iterator[pd.DataFrame]:
    for batch in batches:
        tokens, sizes = _flat(batch.grams)
        owner_of = np.repeat(np.arange(len(batch)), sizes)
        ids = batch.id.to_numpy()
        bands = np.array([plan.band(s) for s in sizes], np.int64)
        for band in np.unique(bands):
            chosen = np.flatnonzero(bands == band)
            local = np.full(len(batch), -1)
            local[chosen] = np.arange(len(chosen))
            mine = local[owner_of] >= 0
            s = Segments(tokens[mine], local[owner_of[mine]], len(chosen), int(band), plan.count(band))
            whole = np.repeat(chosen, s.m)
            yield _rows(s.full, False, ids[whole], sizes[whole])
            each = chosen[s.cell // s.m]
            yield _rows(s.deleted, True, ids[each], sizes[each])


def _buckets(sig: np.ndarray) -> np.ndarray:
    return (sig.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(batches: Iterator[pd.DataFrame], plan: Plan) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 1 << SKETCH_BITS), np.int64)
    for rows in _index(batches, plan):
        sig = rows.sig.to_numpy()
        deleted = (sig & 1).astype(bool)
        for kind in (0, 1):
            counts[kind] += np.bincount(_buckets(sig[deleted == bool(kind)]), minlength=1 << SKETCH_BITS)
    kind, bucket = np.nonzero(counts)
    yield pd.DataFrame({"kind": kind.astype(np.int32), "bucket": bucket.astype(np.int32), "n": counts[kind, bucket]})


def _packed(counts: pd.DataFrame) -> pd.DataFrame:
    """A chunk of the sketch as bytes on a logarithmic scale, which is enough for prices."""
    cells = np.zeros(_CHUNK, np.int64)
    cells[counts.bucket.to_numpy() % _CHUNK] = counts.n
    scaled = np.minimum(255, np.round(8 * np.log2(1 + cells))).astype(np.uint8)
    return pd.DataFrame({"chunk": [int(counts.chunk.iloc[0])], "cells": [scaled.tobytes()]})


def _prices(filled: DataFrame, plan: Plan) -> np.ndarray:
    """The sketch: a byte for each bucket, of full and of deleted signatures."""
    counted = filled.mapInPandas(partial(_sketch, plan=plan), "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    chunk = (F.col("kind") * F.lit((1 << SKETCH_BITS) // _CHUNK) + F.floor(F.col("bucket") / _CHUNK)).cast("int")
    chunks = counted.withColumn("chunk", chunk).groupBy("chunk").applyInPandas(_packed, "chunk int, cells binary").collect()
    prices = np.zeros((2 << SKETCH_BITS) // _CHUNK * _CHUNK, np.uint8)  # of this size, whatever the number of sets
    for row in chunks:
        prices[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.cells, np.uint8)
    return prices.reshape(2, -1)


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size and a parity bitmap of each set: in as many bits as two bitmaps differ, the sets differ at least."""
    for batch in batches:
        tokens, sizes = _flat(batch.grams)
        owner = np.repeat(np.arange(len(batch)), sizes)
        bit = (_mix(tokens) >> np.uint64(50)).astype(np.int64) % _OUTLINE
        odd = np.bincount(owner * _OUTLINE + bit, minlength=len(batch) * _OUTLINE) & 1
        words = np.packbits(odd.astype(np.uint8).reshape(len(batch), _OUTLINE), axis=1).view(np.int64)
        yield pd.DataFrame({"id": batch.id, "n": sizes.astype(np.int32)} | {f"w{k}": words[:, k] for k in range(words.shape[1])})


def _allocate(one: np.ndarray, two: np.ndarray, need: int) -> np.ndarray:
    """Tolerance 0, 1 or 2 of each segment with a sum of at least ``need``, cheaply.

    ``one`` and ``two`` (sets x segments) are the costs of tolerance 1 and 2. Units are
    bought in the order of their price, a pair at its mean price where the second unit is
    the cheaper one; what exceeds the need is given back where it saves most.
    """
    n, m = one.shape
    pair = two < 2 * one
    first = np.where(pair, two / 2, one)
    second = np.where(pair, two / 2, two - one)
    price = np.concatenate([first, second], axis=1)
    segment = np.tile(np.arange(m), 2)
    order = np.argsort(price, axis=1, kind="stable")[:, :need]
    tolerance = np.zeros((n, m), np.int8)
    rows = np.repeat(np.arange(n), order.shape[1])
    np.add.at(tolerance, (rows, segment[order].ravel()), 1)
    # a pair of which only one unit was bought: the unit alone may cost more, so buy both
    half = (tolerance == 1) & pair & (two <= one)
    tolerance[half] = 2
    return tolerance


def _probe(batches: Iterator[pd.DataFrame], plan: Plan, sketch) -> Iterator[pd.DataFrame]:
    scale = np.exp2(np.arange(256) / 8) - 1
    full_count, deleted_count = (lambda b: scale[sketch.value[0][b]]), (lambda b: scale[sketch.value[1][b]])
    for batch in batches:
        tokens, sizes = _flat(batch.grams)
        owner_of = np.repeat(np.arange(len(batch)), sizes)
        ids = batch.id.to_numpy()
        spans = [plan.probed(s) for s in sizes]
        work: dict[tuple[int, int], list[int]] = {}
        for k, (span, size) in enumerate(zip(spans, sizes)):
            for band in span:
                work.setdefault((band, plan.difference(band, size) + 1), []).append(k)
        for (band, need), members in work.items():
            chosen = np.array(members)
            local = np.full(len(batch), -1)
            local[chosen] = np.arange(len(chosen))
            mine = local[owner_of] >= 0
            m = plan.count(band)
            s = Segments(tokens[mine], local[owner_of[mine]], len(chosen), band, m)
            reached = full_count(_buckets(s.full))
            by_deletion = np.bincount(s.cell, full_count(_buckets(s.deleted)) + 1.0, minlength=len(s.full))
            one = 1 + reached
            two = 2 + reached + deleted_count(_buckets(s.full)) + by_deletion
            tolerance = _allocate(one.reshape(-1, m), two.reshape(-1, m), need).ravel()
            whole = np.flatnonzero(tolerance > 0)
            yield _rows(s.full[whole], False, ids[chosen[whole // m]], sizes[chosen[whole // m]])
            loose = np.flatnonzero(tolerance > 1)
            yield _rows(s.full[loose], True, ids[chosen[loose // m]], sizes[chosen[loose // m]])
            each = tolerance[s.cell] > 1
            owner = chosen[s.cell[each] // m]
            yield _rows(s.deleted[each], False, ids[owner], sizes[owner])


def similar_sets(sets: DataFrame, threshold: float, band_ratio: float = 1.3, segments: float = 0.8) -> DataFrame:
    """(a, b, shared, similarity) of all pairs of different sets at or over ``threshold``.

    ``sets`` has ``id`` (bigint, unique) and ``grams`` (sorted distinct array<bigint>);
    empty sets have no partner. Each pair comes once, a < b.
    """
    spark = sets.sparkSession
    plan = Plan(threshold, band_ratio, segments)
    filled = sets.where(F.size("grams") > 0).select("id", "grams")
    shared = spark.sparkContext.broadcast(_prices(filled, plan))
    indexed = filled.mapInPandas(partial(_index, plan=plan), _SIGNATURES)
    probing = filled.mapInPandas(partial(_probe, plan=plan, sketch=shared), _SIGNATURES)
    r, s = indexed.alias("r"), probing.alias("s")
    smaller = (F.col("r.n") < F.col("s.n")) | ((F.col("r.n") == F.col("s.n")) & (F.col("r.id") < F.col("s.id")))
    large_enough = F.col("r.n") >= F.lit(threshold) * F.col("s.n") - 1e-9
    pairs = (
        unpriced(r).join(s, (F.col("r.sig") == F.col("s.sig")) & smaller & large_enough)
        .select(F.least("r.id", "s.id").alias("a"), F.greatest("r.id", "s.id").alias("b"))
        .distinct()
    )
    words = [f"w{k}" for k in range(_OUTLINE // 64)]
    outlines = cut(filled.mapInPandas(_outlines, "id bigint, n int, " + ", ".join(f"{w} bigint" for w in words)))
    x, y = outlines.alias("x"), outlines.alias("y")
    differing = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in words), F.lit(0))
    allowed = F.lit((1 - threshold) / (1 + threshold)) * (F.col("x.n") + F.col("y.n")) + 1e-9
    close = pairs.join(unpriced(x), F.col("a") == F.col("x.id")).join(unpriced(y), F.col("b") == F.col("y.id")).where(differing <= allowed).select("a", "b")
    left = filled.select(F.col("id").alias("a"), F.col("grams").alias("grams_a"))
    right = filled.select(F.col("id").alias("b"), F.col("grams").alias("grams_b"))
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    verified = close.join(unpriced(left), "a").join(unpriced(right), "b").select("a", "b", common.alias("shared"), (F.size("grams_a") + F.size("grams_b")).alias("both"))
    similarity = F.col("shared") / (F.col("both") - F.col("shared"))
    return verified.select("a", "b", "shared", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_groups(records: DataFrame, record_id: str, texts: list[str], width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, group_id, n_links): every record, its class of equal texts and its group.

    Records with the same set of word runs are one class, named by its smallest id and
    compared once. Classes at or over the threshold are linked; a group is everything
    connected, named by its smallest id; ``n_links`` counts the linked classes. A record
    with fewer than ``width`` words is alone, as is one without any similar record. Null
    texts are empty, rows with a null id are left out, repeated rows count once.
    """
    own = records.select(F.col(record_id).cast("bigint").alias("id"), word_runs([F.col(t) for t in texts], width).alias("grams")).where("id is not null")
    own = cut(own.withColumn("key", F.md5(F.concat_ws(",", "grams"))))
    has_runs = F.size("grams") > 0
    # classes are settled on ids and keys; the runs are fetched last, for one record of each class
    keyed = own.where(has_runs).select("id", "key")
    classes = keyed.groupBy("key").agg(F.min("id").alias("class_id"))
    members = keyed.join(unpriced(classes), "key").select("id", "class_id").distinct()
    # one id may stand under several texts; it then belongs to the class of each
    first = classes.select(F.col("class_id").alias("id"), "key")
    sets = cut(own.where(has_runs).join(unpriced(first), ["id", "key"]).select("id", "grams").dropDuplicates(["id"]))
    links = cut(similar_sets(sets, threshold))
    groups = connected_components(links, "a", "b").withColumnsRenamed({"node": "class_id", "component": "group_id"})
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    alone = own.where(~has_runs).select("id", F.col("id").alias("class_id")).distinct()
    return (
        members.unionByName(alone)
        .join(unpriced(groups), "class_id", "left")
        .join(unpriced(degree), "class_id", "left")
        .select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def all_pairs(groups: DataFrame, name: str) -> DataFrame:
    """(<name>_a, <name>_b), a < b: every pair of different ids of each group, copies as well.

    ``groups`` has ``id`` and ``group_id``. One side of a large group is salted and the
    other repeated for each salt, so that its pairs are made in many tasks.
    """
    members = groups.select("group_id", "id").distinct()
    sized = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    salts = F.ceil(F.col("n") / PAIRED_IN_TASK).cast("int")
    spread = members.join(unpriced(sized.withColumn("salts", salts)), "group_id")
    a = spread.select("group_id", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias(f"{name}_a"))
    b = spread.select("group_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias(f"{name}_b"))
    return unpriced(a).join(b, ["group_id", "salt"]).where(F.col(f"{name}_a") < F.col(f"{name}_b")).select(f"{name}_a", f"{name}_b")
