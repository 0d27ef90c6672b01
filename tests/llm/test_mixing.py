import random
from collections import Counter

import numpy as np

from mnemograph.llm.mixing import mix, quotas, shard_intervals
from mnemograph.llm.tokens import encoding, DEFAULT_VOCABULARY

DOCS = "doc_id bigint, text string, source string, shard int, copy int, n_tokens int"
TARGETS = "source string, target_share double, max_repeats int, doc_id int"


def test_quotas_keep_ratios():
    got = quotas({"a": 1000, "b": 10, "c": 0}, {"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.2}, {"a": 2, "b": 3, "c": 9, "d": 1}, 900)
    assert got["b"] == 30 and got["c"] == got["d"] == 0 and got["a"] == 870


def test_intervals_are_disjoint_and_complete(spark):
    draws = [1000, 7, 0, 333]
    rows = shard_intervals(spark, ["a", "b", "c", "d"], draws, 600, seed=3).collect()
    for name, n in zip("abcd", draws):
        at = sorted(x for r in rows if r.source == name for x in range(r.first, r.first + r.n))
        assert at == list(range(n))
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.n
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(600)) <= 3


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(3, 60))), s, 0, 0, 0) for i, s in enumerate(["big"] * 600 + ["mid"] * 120 + ["small"] * 20 + ["loose"] * 30)]
    docs += [(5000, None, "big", 0, 0, 0), (5001, "", "big", 0, 0, 0), (5002, "text", None, 0, 0, 0)]
    targets = [("big", 0.5, 1, 0), ("mid", 0.3, 3, 0), ("small", 0.15, 2, 0), ("gone", 0.05, 2, 0), (None, 0.1, 2, 0), ("nothing", None, None, 0)]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)
    mixed, report = mix(d, t, shard_tokens=3000, block_tokens=400)
    rows = mixed.collect()
    encode = encoding(DEFAULT_VOCABULARY).encode_ordinary
    text = {x[0]: x[1] for x in docs}
    assert all(r.n_tokens == len(encode(text[r.doc_id])) for r in rows)
    tokens = Counter()
    copies = {}
    for r in rows:
        tokens[r.source] += r.n_tokens
        copies.setdefault((r.source, r.doc_id), []).append(r.copy)
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())  # each copy once, in turn
    assert {s: max(len(c) for (x, _), c in copies.items() if x == s) for s in tokens} == {"big": 1, "mid": 3, "small": 2}
    available = Counter()
    for i, x, s, *_ in docs:
        if x and s in ("big", "mid", "small"):
            available[s] += len(encode(x))
    want = quotas(available, {"big": 0.5, "mid": 0.3, "small": 0.15, "gone": 0.05, "nothing": 0}, {"big": 1, "mid": 3, "small": 2, "gone": 2, "nothing": 0}, sum(available.values()))
    assert all(abs(tokens[s] - want[s]) <= 70 for s in tokens)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in shards.values()) and len(shards) >= 5
    said = {r.source: r for r in report.collect()}
    assert abs(sum(r.reached_share for r in said.values()) - 1) < 1e-9 and said["small"].capped and not said["mid"].capped
    assert said["gone"].mixed_tokens == 0 and said["mid"].mixed_tokens == tokens["mid"]
    assert sorted(mix(d, t, shard_tokens=3000, block_tokens=400)[0].collect()) == sorted(rows)


def test_empty(spark):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGETS)
    mixed, report = mix(d, t)
    assert mixed.count() == 0 and report.count() == 0
    some = spark.createDataFrame([("a", 1.0, 2, 0)], TARGETS)
    mixed, report = mix(d, some)
    assert mixed.count() == 0 and [r.reached_share for r in report.collect()] == [0.0]


def test_permutations_reach_every_block():
    from mnemograph.llm.mixing import permutation

    orders = set()
    for n in (1, 2, 6, 64, 97, 5000):
        for copy in range(3):
            factor, shift = permutation("a", copy, n, 17)
            order = tuple((factor * i + shift) % n for i in range(n))
            assert sorted(order) == list(range(n))
            orders.add(order)
    assert len(orders) >= 13  # passes differ


def test_many_small_blocks(spark):
    """More blocks than one range of positions: the part of a pass still ends at the quota."""
    docs = spark.range(12_000).selectExpr("id AS doc_id", "concat('alpha beta ', id) AS text", "'a' AS source", "0 AS shard", "0 AS copy", "0 AS n_tokens")
    targets = spark.createDataFrame([("a", 1.0, 3, 0)], TARGETS)
    mixed, report = mix(docs, targets, total_tokens=60_000, shard_tokens=9000, block_tokens=6)
    said = report.first()
    assert said.mixed_tokens <= said.available_tokens * 3 and abs(said.mixed_tokens - min(60_000, 3 * said.available_tokens)) <= 10
    per_shard = mixed.groupBy("shard").sum("n_tokens").collect()
    assert len(per_shard) == -(-min(60_000, 3 * said.available_tokens) // 9000) and all(abs(r[1] - 60_000 / len(per_shard)) < 1500 for r in per_shard)
    assert mixed.groupBy("doc_id", "copy").count().where("count > 1").count() == 0


def test_texts_come_with_the_mix(spark):
    from mnemograph.llm.mixing import mixed_texts

    docs = spark.createDataFrame([(i, f"word {i}", "a", 0, 0, 0) for i in range(50)], DOCS)
    mixed, _ = mix(docs, spark.createDataFrame([("a", 1.0, 2, 0)], TARGETS), block_tokens=20)
    rows = mixed_texts(mixed, docs).collect()
    assert len(rows) == 50 and all(r.text == f"word {r.doc_id}" for r in rows)
