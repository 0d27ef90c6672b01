"""Exact nearest neighbours for a set of queries, in blocks of a matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.session import cut

#: numbers of a block of query vectors: what is sent to every task, whatever the number of queries
BLOCK_NUMBERS = 1_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, for pairs that are given."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def score_of_cosine(value: Column) -> Column:
    """(1 + cos) / 2, with the distance clamped to 0..2."""
    return 1 - F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - value)) / 2


def _unit(vectors: list) -> np.ndarray:
    v = np.array(vectors, np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _merged(kept: np.ndarray, near: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists for each query, by score and then id."""
    scores, ids = np.concatenate([kept, scores], axis=1), np.concatenate([near, ids], axis=1)
    by_id = np.argsort(ids, axis=1, kind="stable")
    scores, ids = np.take_along_axis(scores, by_id, axis=1), np.take_along_axis(ids, by_id, axis=1)
    top = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, top, axis=1), np.take_along_axis(ids, top, axis=1)


def exact_knn(
    queries: DataFrame, vectors: DataFrame, k: int, id_type: str = "bigint", query_type: str = "bigint", group_type: str | None = None, threshold: float | None = None, skip_self: bool = False
) -> DataFrame:
    """(query_id, id, score, place): the k best vectors of each query, by score and then id.

    ``queries`` has query_id and vec, ``vectors`` id and vec; with ``group_type`` both have
    ``grp`` and a query only sees its group. Filter the vectors before: neighbours are taken
    among what is given. Vectors are finite, of one length and not all zero. Queries are sent
    to the vectors in blocks of bounded size; every task keeps k candidates of a query.
    """
    q = queries.select("query_id", "vec", *(["grp"] if group_type else []))
    first = q.select(F.size("vec").alias("d")).first()
    empty = vectors.sparkSession.createDataFrame([], f"query_id {query_type}, id {id_type}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    if first is None:
        return empty.withColumn("place", F.row_number().over(best))
    rows = max(1, BLOCK_NUMBERS // max(1, first.d))
    parts = -(-q.count() // rows) or 1
    found = None
    if parts > 1:
        q = cut(q)
    for part in range(parts):
        # a hash split keeps the parts near that size
        chosen = q if parts == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        shared = vectors.sparkSession.sparkContext.broadcast(chosen.toPandas())

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block = shared.value
            matrix = _unit(block.vec.tolist())
            ids = block.query_id.to_numpy()
            kept, near = np.full((len(ids), 0), -1.0), np.empty((len(ids), 0), block.query_id.to_numpy()[:0].dtype)
            for batch in batches:
                if not len(batch):
                    continue
                batch = batch.sort_values("id", ignore_index=True)
                scores = (1 + np.clip(matrix @ _unit(batch.vec.tolist()).T, -1, 1)) / 2
                own = batch.id.to_numpy()
                if group_type:
                    scores[block.grp.to_numpy()[:, None] != batch.grp.to_numpy()[None, :]] = -1
                if skip_self:
                    scores[ids[:, None] == own[None, :]] = -1
                if threshold is not None:
                    scores[scores < threshold] = -1
                top = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
                kept, near = _merged(kept, near.astype(own.dtype), np.take_along_axis(scores, top, axis=1), own[top], k)
            row, slot = np.nonzero(kept >= 0)
            yield pd.DataFrame({"query_id": ids[row], "id": near[row, slot], "score": kept[row, slot]})

        columns = ["id", "vec"] + ["grp"] * bool(group_type)
        hits = vectors.select(*columns).mapInPandas(scan, f"query_id {query_type}, id {id_type}, score double")
        found = hits if found is None else found.unionByName(hits)
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def score_pairs(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Scores of given (query_id, id) pairs: two joins, no search."""
    left = queries.select("query_id", F.col("vec").alias("_q"))
    right = vectors.select("id", F.col("vec").alias("_v"))
    return pairs.join(left, "query_id").join(right, "id").withColumn("score", score_of_cosine(cosine(F.col("_q"), F.col("_v")))).drop("_q", "_v")


def score_missing(pairs: DataFrame, known: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, id, score) of pairs: the score that ``known`` has, else computed; only those fetch vectors."""
    marked = pairs.select("query_id", "id").distinct().join(known.select("query_id", "id", "score"), ["query_id", "id"], "left")
    fresh = score_pairs(marked.where("score is null").select("query_id", "id"), queries, vectors)
    return marked.where("score is not null").unionByName(fresh.select("query_id", "id", "score"))


def vector_of(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, vec) of the asked ids that have a vector."""
    return vectors.join(ids.select("id").distinct(), "id", "left_semi").select("id", "vec")


def pack_vector(vector: Column, dimensions: int = 128) -> Column:
    """The first ``dimensions`` numbers as little-endian single precision floats in one binary; null stays null."""

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v[:dimensions], "<f4").tobytes())

    return pack(vector)


def unpack_vector(packed: Column) -> Column:
    """The numbers of a packed vector."""

    @F.pandas_udf("array<float>")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.frombuffer(v, "<f4"))

    return unpack(packed)
