import datetime
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from mnemograph.llm import neighbours
from mnemograph.llm.neighbours import similar_events, similar_pairs
from mnemograph.llm.vp_tree import VPTree

SCHEMA = "event_id string, v array<float>, is_delete boolean, created_time timestamp_ntz, class_id string, vec int"
DAY = datetime.datetime(2024, 1, 1)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def clustered(rng, n, d=12):
    centres = rng.normal(size=(max(1, n // 6), d))
    return centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, d))


def test_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(1)
    x = unit(clustered(rng, 900))
    best, dots = VPTree(x).search(x, np.arange(900), 5, np.full(900, 2.0), 1.0)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert np.allclose(dots, -np.sort(-s, axis=1)[:, :5])
    assert np.allclose(np.take_along_axis(s, best, axis=1), dots)


def brute(rows, k):
    last = {}
    for e, v, gone, at, *_ in rows:
        if e is not None and (e not in last or at >= last[e][1]):
            last[e] = (v, at, gone)
    good = {e: unit(np.array(v, float)) for e, (v, _, gone) in last.items() if not gone and v is not None and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    out = set()
    for a in ids:
        near = sorted((-round(float(good[a] @ good[b]), 9), b) for b in ids if b != a)[:k]
        out |= {(a, i + 1, b) for i, (_, b) in enumerate(near)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = clustered(rng, 260).astype(np.float32)
    rows = [(f"e{i:03}", v.tolist(), None if i % 7 else False, DAY, "clash", 1) for i, v in enumerate(x)]
    rows += [(f"c{i:03}", x[0].tolist(), False, DAY, "", 1) for i in range(40)]  # copies
    rows += [("x1", None, False, DAY, "", 1), ("x2", [1.0] * 11, False, DAY, "", 1), ("x3", [float("nan")] * 12, False, DAY, "", 1), ("x4", [0.0] * 12, False, DAY, "", 1), ("x5", [1.0] * 12, True, DAY, "", 1), ("x6", [float("inf")] + [0.0] * 11, False, DAY, "", 1)]
    rows += [("e001", x[1].tolist(), True, DAY + datetime.timedelta(1), "", 1), (None, [1.0] * 12, False, DAY, "", 1), rows[5], ("x7", [None] + [1.0] * 11, False, DAY, "", 1)]
    return rows


def test_exact_at_factor_one(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = similar_events(df, "v", k=4, factor=1.0, dimensions=12, shard_rows=30, block_rows=25).collect()
    want = brute(rows, 4)
    assert {(r.event_id, r.place, r.other_id) for r in got} == want


@pytest.mark.parametrize("factor", [1.0, 0.5])
def test_shards_with_pivots_of_their_own(spark, rows, factor):
    """Three pivots of the first level: every shard is cut into cells of about 25 classes."""
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.event_id, r.place, r.other_id) for r in similar_events(df, "v", k=4, factor=factor, dimensions=12, shard_rows=30, block_rows=25, max_pivots=3).collect()}
    want = brute(rows, 4)
    assert got == want if factor == 1 else len(got & want) / len(want) >= 0.9


def test_recall_of_the_shipped_factor(spark):
    """Against brute force at 128 dimensions, the default factor and the default sizes of shards."""
    rng = np.random.default_rng(9)
    x = clustered(rng, 9000, 128).astype(np.float32)
    df = spark.createDataFrame([(f"e{i:05}", v.tolist(), False, DAY, "", 1) for i, v in enumerate(x)], SCHEMA)
    got = {(int(r.event_id[1:]), int(r.other_id[1:])) for r in similar_events(df, "v", k=5).collect()}
    s = unit(x.astype(float)) @ unit(x.astype(float)).T
    np.fill_diagonal(s, -1)
    near = np.argpartition(-s, 5, axis=1)[:, :5]
    want = {(i, int(j)) for i in range(len(x)) for j in near[i]}
    assert len(got & want) / len(want) >= 0.9


def test_relaxed_recall_and_pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 4)
    got = {(r.event_id, r.place, r.other_id) for r in similar_events(df, "v", k=4, factor=0.5, dimensions=12, shard_rows=30, block_rows=40).collect()}
    assert len(got & want) / len(want) >= 0.9
    pairs = similar_pairs(df, ("v",), 4, 0.9, factor=1.0, dimensions=12, shard_rows=30, block_rows=40).collect()
    vectors = {e: unit(np.array(v, float)) for e, v, *_ in rows if v is not None and None not in v and len(v) == 12}
    close = {(min(a, b), max(a, b)) for a, _, b in want if (1 + vectors[a] @ vectors[b]) / 2 >= 0.9}
    assert {(r.event_id_a, r.event_id_b) for r in pairs} == close


def test_small(spark):
    assert similar_events(spark.createDataFrame([], SCHEMA), "v", dimensions=12).count() == 0
    assert similar_events(spark.createDataFrame([("a", [1.0] * 12, False, None, "", 1)], SCHEMA), "v", dimensions=12).count() == 0
    two = [("a", [1.0] * 12, False, None, "", 1), ("b", [2.0] * 12, None, None, "", 1)]
    assert similar_events(spark.createDataFrame(two, SCHEMA), "v", dimensions=12).count() == 2


def test_queries_pass_by_a_block():
    """Every query meets all cells of a block, and memory does not grow with the queries."""
    rng = np.random.default_rng(3)
    x = clustered(rng, 3000, 32).astype(np.float32)
    lists = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float32()))
    names = ["task", "kind", "cell", "class_id", "vec", "reach", "cells"]

    def rows(kind, ids, cell, v, reach, cells):
        n = len(v)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, 4)), pa.array(np.full(n, kind)), pa.array(cell), pa.array(ids), lists(v), pa.array([reach] * n, pa.float64()), pa.array([cells] * n, pa.list_(pa.int64()))], names=names)

    def batches(n):
        yield rows(0, [f"e{i:04}" for i in range(3000)], np.arange(3000) // 500, x, None, None)
        for low in range(0, n, 1000):
            yield rows(1, [f"q{low + i}" for i in range(1000)], np.zeros(1000, int), x[:1000] + 0.01, 0.2, [0, 1, 2, 3, 4, 5])

    near = unit(x[:1000].astype(float) + 0.01) @ unit(x.astype(float)).T >= 1 - 0.2**2 / 2
    peaks = []
    for n in (4000, 40_000):
        tracemalloc.start()
        assert sum(b.num_rows for b in neighbours._streamed(batches(n), 500, 1.0)) == near.sum() * n // 1000
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]
