"""A mix of sources by target shares of tokens (problem 7).

Every source is cut by hash into blocks of documents of a fixed size. A source's token
quota becomes a count of block draws: whole passes over its blocks, then a part of a pass,
each in an order of its own that a keyed permutation of the block numbers gives, so that
nothing is ranked by source. A
splitting tree hands the counts of all sources to the output shards: each node divides its
count vector between its halves by a multivariate hypergeometric draw, which is how a
perfectly shuffled deck would fall, so the shards' quotas are exact and disjoint. The
documents of a shard are shuffled within the shard.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.llm.tokens import DEFAULT_VOCABULARY, token_counter
from mnemograph.session import broadcast_if_small, cut, unpriced

#: most sources that may have a target, beyond which a mix raises: a node of the splitting tree counts each of them
MAX_SOURCES = 100_000
#: positions of a pass that are summed up together, in the first of two steps
RANGE = 4096
#: nodes of the splitting tree that the driver makes; tasks grow the subtrees below them
DRIVER_NODES = 256


def quotas(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int) -> dict[str, float]:
    """Tokens of each source: its share of ``total`` up to ``repeats`` times what it has.

    What a capped source cannot give goes to the others in proportion to their shares, so
    the uncapped sources keep their ratios. The sum is below ``total`` only if all are capped.
    """
    given = dict.fromkeys(shares, 0.0)
    open_ = {s for s in shares if available.get(s, 0) > 0 and shares[s] > 0 and repeats[s] > 0}
    rest = float(total)
    while open_:
        weight = sum(shares[s] for s in open_)
        wanted = {s: rest * shares[s] / weight for s in open_}
        full = {s for s in open_ if wanted[s] >= available[s] * repeats[s]}
        if not full:
            return given | wanted
        for s in full:
            given[s] = float(available[s] * repeats[s])
        rest = total - sum(given.values())
        open_ -= full
    return given


def _split(node: tuple[int, int, np.ndarray, np.ndarray], seed: int):
    """The two halves of a node (first shard, last shard + 1, first positions, counts)."""
    low, high, first, counts = node
    middle = (low + high) // 2
    rng = np.random.default_rng([seed, low, high])
    n_left = round(int(counts.sum()) * (middle - low) / (high - low))
    left = rng.multivariate_hypergeometric(counts, n_left, method="marginals") if counts.sum() else counts.copy()
    return (low, middle, first, left), (middle, high, first + left, counts - left)


def permutation(source: str, copy: int, n: int, seed: int) -> tuple[int, int]:
    """(factor, shift) of the permutation factor * i + shift mod n of 0..n-1, by source and pass.

    The factor has no divisor in common with n; products stay within 64 bits for up to
    2^32 blocks, beyond which this raises.
    """
    if n >= 1 << 32:
        raise ValueError("too many blocks of one source; take larger ones")
    rng = np.random.default_rng([seed, copy, zlib.crc32(source.encode())])
    factor = int(rng.integers(1, max(2, min(n, 1 << 31))))
    while math.gcd(factor, n) > 1:
        factor += 1
    return factor, int(rng.integers(0, n))


def _part_of_pass(blocks: DataFrame) -> DataFrame:
    """The first blocks of a pass, in its order, that are needed for ``rest`` tokens, with the room each has.

    Tokens before a block are summed in two steps, over ranges of positions and within
    them, so no source is sorted in one task.
    """
    ranged = blocks.withColumn("range", F.floor(F.col("at") / RANGE))
    sums = ranged.groupBy("source", "range").agg(F.sum("tokens").alias("n"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each RANGE blocks
    starts = sums.select("source", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    placed = ranged.join(unpriced(starts), ["source", "range"]).withColumn("before", before)
    return placed.where(F.col("before") < F.col("rest")).select("source", "block", "tokens", "copy", "n_blocks", (F.col("rest") - F.col("before")).alias("room"), "at")


def shard_intervals(spark, sources: list[str], draws: list[int], shards: int, seed: int) -> DataFrame:
    """(source, shard, first, n): which of a source's positions 0..draws-1 each shard takes."""
    nodes = [(0, shards, np.zeros(len(sources), np.int64), np.array(draws, np.int64))]
    while len(nodes) < min(DRIVER_NODES, shards) and any(b - a > 1 for a, b, _, _ in nodes):
        nodes = [x for node in nodes for x in (_split(node, seed) if node[1] - node[0] > 1 else (node,))]

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                stack = [(row.low, row.high, np.array(row.first), np.array(row.counts))]
                while stack:
                    node = stack.pop()
                    if node[1] - node[0] > 1:
                        stack.extend(_split(node, seed))
                    elif len(some := np.flatnonzero(node[3])):
                        yield pd.DataFrame({"source": [sources[i] for i in some], "shard": node[0], "first": node[2][some], "n": node[3][some]})

    rows = [(a, b, f.tolist(), c.tolist()) for a, b, f, c in nodes]
    tops = spark.createDataFrame(rows, "low int, high int, first array<bigint>, counts array<bigint>")
    return tops.mapInPandas(grow, "source string, shard int, first bigint, n bigint")


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    shard_tokens: int = 1_000_000,
    block_tokens: int = 65_536,
    seed: int = 17,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, position, source, doc_id, copy, n_tokens) and its report.

    ``total_tokens`` is the size of the mix, by default all tokens of the sources that have
    a target. ``copy`` counts from 0 and stays under the source's ``max_repeats``; a source
    is repeated only after all its documents were taken. The last copy of a source ends
    with the document that brings it nearest to its quota, so a share is met up to one
    document. Equal seeds give equal mixes.

    Null or empty texts, null sources and sources without a target are left out; a target
    with a null or non-positive share or cap takes nothing; of repeated targets for a
    source the first by share and cap holds. Repeated documents are documents of their own.
    Empty tables give an empty mix. The report has a row for each target: source,
    target_share, reached_share, max_repeats, available_tokens, mixed_tokens,
    mixed_documents, copies, capped.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.min(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("r"))).alias("t"))
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    shares = {r.source: max(0.0, r.t.s) for r in rows}
    repeats = {r.source: max(0, r.t.r) for r in rows}

    names = broadcast_if_small(wanted.select("source"), MAX_SOURCES)
    counted = documents.where("text is not null and text != '' and source is not null").join(names, "source")
    sized = cut(counted.select("doc_id", "source", token_counter(vocabulary)("text").alias("n_tokens"), F.xxhash64("doc_id", F.lit(seed)).alias("h")).where("n_tokens > 0"))
    available = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(available.values()) if total_tokens is None else total_tokens
    quota = quotas(available, shares, repeats, total)

    plan = [(s, max(1, math.ceil(available[s] / block_tokens)), float(q), q // available[s] if q else 0.0) for s, q in quota.items() if q > 0]
    blocks_of = {s: n for s, n, _, _ in plan}
    rows = [(s, k, n, *permutation(s, k, n, seed), None if k < full else q - full * available[s]) for s, n, q, full in plan for k in range(int(full) + 1)]
    passes_of = spark.createDataFrame(rows, "source string, copy int, n_blocks bigint, factor bigint, shift bigint, rest double")
    numbered = broadcast_if_small(passes_of.where("copy = 0").select("source", "n_blocks"), MAX_SOURCES)
    placed = sized.join(numbered, "source").withColumn("block", F.pmod("h", "n_blocks"))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))

    # every pass over a source takes its blocks in an order of its own; the last pass is a part
    at = F.pmod(F.col("factor") * F.col("block") + F.col("shift"), F.col("n_blocks"))
    passes = blocks.join(broadcast_if_small(passes_of, MAX_SOURCES), "source").select("source", "block", "tokens", "copy", "n_blocks", "rest", at.alias("at"))
    drawn = cut(passes.where("rest is null").select("source", "block", "tokens", "copy", "n_blocks", F.lit(None).cast("double").alias("room"), "at").unionByName(_part_of_pass(passes.where("rest is not null"))))
    drawn = drawn.withColumn("at", F.col("copy") * F.col("n_blocks") + F.col("at")).drop("n_blocks")

    # a pass without documents at its last positions counts them nevertheless
    last = {r.source: r.n for r in drawn.groupBy("source").agg((F.max("at") + 1).alias("n")).collect()}
    counts = {s: max(n, blocks_of[s] * int(full)) for (s, _, _, full) in plan if (n := last.get(s))}
    order_of = sorted(counts)
    shards = max(1, math.ceil(sum(quota.values()) / shard_tokens))
    intervals = shard_intervals(spark, order_of, [counts[s] for s in order_of], shards, seed)
    positions = intervals.select("source", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"))
    draws = drawn.join(unpriced(positions), ["source", "at"]).select("source", "block", "copy", "room", "tokens", "shard")

    # blocks hold a bounded share of a source, so the documents' order in a block is small work
    inner = Window.partitionBy("source", "block").orderBy("h", "doc_id")
    ranked = placed.withColumn("before", F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens"))
    taken = ranked.join(unpriced(draws), ["source", "block"])
    nearest = F.col("before") + F.col("n_tokens") / 2 <= F.col("room")
    taken = taken.where(F.col("room").isNull() | (F.col("room") >= F.col("tokens")) | nearest)
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", "shard", F.lit(seed)), "doc_id", "copy")
    out = taken.select("shard", (F.row_number().over(shuffled) - 1).alias("position"), "source", "doc_id", "copy", "n_tokens")

    reached = out.groupBy("source").agg(
        F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_documents"), (F.max("copy") + 1).alias("copies")
    )
    known = spark.createDataFrame(
        [(s, shares[s], repeats[s], available.get(s, 0), bool(quota[s] >= available.get(s, 0) * repeats[s])) for s in shares],
        "source string, target_share double, max_repeats int, available_tokens bigint, capped boolean",
    )
    joined = known.join(reached, "source", "left").fillna(0, ["mixed_tokens", "mixed_documents", "copies"])
    everything = Window.partitionBy()  # a row for each target
    whole = F.sum("mixed_tokens").over(everything)
    report = joined.select(
        "source", "target_share", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0).alias("reached_share"),
        "max_repeats", "available_tokens", "mixed_tokens", "mixed_documents", "copies", "capped",
    )
    return out, report


def mixed_texts(mixed: DataFrame, documents: DataFrame) -> DataFrame:
    """The mix with the documents' texts, for writing it out by shard."""
    return mixed.join(unpriced(documents.select("doc_id", "text")), "doc_id")
