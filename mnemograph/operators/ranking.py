"""Fusion and ranking of candidates; ties always go by an explicit last key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.operators.filters import per_key_limit


def merge_max(parts: list[DataFrame]) -> DataFrame:
    """(query_id, id, score): the greatest score of an id over the parts."""
    both = parts[0].select("query_id", "id", "score")
    for p in parts[1:]:
        both = both.unionByName(p.select("query_id", "id", "score"))
    return both.groupBy("query_id", "id").agg(F.max("score").alias("score"))


#: digits to which scores are compared: the order of a sum must not decide a tie
DIGITS = 9


def by_score(column: str = "score") -> Column:
    return F.desc(F.round(column, DIGITS))


def top(rows: DataFrame, n: int) -> DataFrame:
    return per_key_limit(rows, ["query_id"], [by_score(), F.col("id")], n)


def ordered_union(parts: list[DataFrame]) -> DataFrame:
    """(query_id, id, pos): parts one after another, the first occurrence of an id wins.

    Parts have query_id, id and pos; null ids are dropped. New positions count from 0.
    """
    marked = [p.select("query_id", "id", F.struct(F.lit(i).alias("part"), "pos").alias("at")) for i, p in enumerate(parts)]
    both = marked[0]
    for p in marked[1:]:
        both = both.unionByName(p)
    first = both.where("id is not null").groupBy("query_id", "id").agg(F.min("at").alias("at"))
    return first.select("query_id", "id", (F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id")) - 1).alias("pos"))


def reciprocal_rank_fusion(vector: DataFrame, keyword: DataFrame, k: int = 60, n: int = 10) -> DataFrame:
    """(query_id, id, score, place): 1 / (k + rank) by both lists; ids are those of the first.

    An id that the second list lacks ranks behind all ids of the first list.
    """
    place = lambda: F.row_number().over(Window.partitionBy("query_id").orderBy(by_score(), "id"))
    by_vector = vector.select("query_id", "id", place().alias("r1"), F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("n"))
    kept = keyword.join(vector.select("query_id", "id"), ["query_id", "id"], "left_semi")
    by_keyword = kept.select("query_id", "id", place().alias("r2"))
    score = 1 / (k + F.col("r1")) + 1 / (k + F.coalesce("r2", F.col("n") + 1))
    return top(by_vector.join(by_keyword, ["query_id", "id"], "left").select("query_id", "id", score.alias("score")), n)


def channel_merge(entity: DataFrame, vector: DataFrame) -> DataFrame:
    """(query_id, id, score, from_entity, from_vector): what each channel found, with the vector score."""
    both = entity.select("query_id", "id", F.lit(0.0).alias("score"), F.lit(1).alias("e"), F.lit(0).alias("v")).unionByName(
        vector.select("query_id", "id", "score", F.lit(0).alias("e"), F.lit(1).alias("v"))
    )
    return both.groupBy("query_id", "id").agg(F.max("score").alias("score"), (F.max("e") == 1).alias("from_entity"), (F.max("v") == 1).alias("from_vector"))


def fast_score(merged: DataFrame, weights: tuple[float, float, float] = (0.85, 0.15, 0.05)) -> DataFrame:
    """Adds fast_score: scores scaled to 0..1 within a query, with bonuses.

    One is for an event that touches an entity of the query, by whatever channel it came,
    and one for an event of both channels.
    """
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = F.when(high - low <= 1e-9, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    both = F.col("from_entity") & F.col("from_vector")
    total = weights[0] * scaled + F.when(F.col("touches_seed"), weights[1]).otherwise(0.0) + F.when(both, weights[2]).otherwise(0.0)
    return merged.withColumn("fast_score", total)


def rerank_fill(candidates: DataFrame, model: DataFrame, top_k: int, most: int, similarity_threshold: float = 0.3, model_threshold: float = 0.0) -> DataFrame:
    """(query_id, id, place, is_fill): the model's best, then the most similar candidates.

    ``candidates`` has query_id, id, score, pos; ``model`` query_id, id, score, of which
    numbers that are not finite and ids that are no candidates are ignored. Where the model
    gives nothing for a query the candidates stay in their order.
    """
    sound = model.where(~F.isnan("score") & (F.abs("score") < float("inf"))).groupBy("query_id", "id").agg(F.max("score").alias("model_score"))
    known = candidates.join(sound, ["query_id", "id"], "left")
    answered = F.max(F.col("model_score").isNotNull().cast("int")).over(Window.partitionBy("query_id")) == 1
    marked = known.withColumn("answered", answered)
    chosen = per_key_limit(marked.where(F.col("model_score") >= model_threshold), ["query_id"], [F.desc("model_score"), F.col("pos")], top_k)
    head = chosen.select("query_id", "id", F.lit(0).alias("tier"), F.col("place").cast("double").alias("by"), "pos")
    rest = marked.join(head.select("query_id", "id"), ["query_id", "id"], "left_anti")
    fill = rest.where(~F.col("answered") | (F.col("score") >= similarity_threshold)).select(
        "query_id", "id", F.lit(1).alias("tier"), F.when(F.col("answered"), -F.col("score")).otherwise(F.lit(0.0)).alias("by"), "pos"
    )
    ordered = per_key_limit(head.unionByName(fill), ["query_id"], [F.col("tier"), F.col("by"), F.col("pos")], most)
    return ordered.select("query_id", "id", "place", (F.col("tier") == 1).alias("is_fill"))


def chosen_indices(reply: Column) -> Column:
    """The numbers in square brackets of a model's reply, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(reply, F.lit(r"\[\s*(\d+)\s*\]"), F.lit(1)), lambda x: x.cast("int")))


def reply_fill(candidates: DataFrame, replies: DataFrame, most: int, threshold: float = 0.3) -> DataFrame:
    """(query_id, id, place, is_fill, failed): candidates that a reply names by index, then others in order.

    ``candidates`` has query_id, id, score, pos (from 0); ``replies`` query_id and reply.
    Without a usable index the first candidates are taken and ``failed`` is true.
    """
    named = replies.select("query_id", F.posexplode(chosen_indices(F.col("reply"))).alias("order", "pos"))
    marked = candidates.join(named, ["query_id", "pos"], "left")
    failed = F.max(F.col("order").isNotNull().cast("int")).over(Window.partitionBy("query_id")) == 0
    marked = marked.withColumn("failed", failed).where(F.col("order").isNotNull() | F.col("failed") | (F.col("score") >= threshold))
    ordered = per_key_limit(marked, ["query_id"], [F.col("order").isNull(), F.col("order"), F.col("pos")], most)
    return ordered.select("query_id", "id", "place", F.col("order").isNull().alias("is_fill"), "failed")


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], keep_null: str | None = None) -> DataFrame:
    """The first row of each key; rows whose ``keep_null`` is null are all kept."""
    window = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_n", F.row_number().over(window))
    kept = F.col("_n") == 1
    return marked.where(kept | F.col(keep_null).isNull() if keep_null else kept).drop("_n")


def ranked_results(ids: DataFrame, scores: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(query_id, id, pos, score[, rank_score]): ids in their order with their scores, 0 where there is none."""
    out = ids.select("query_id", "id", "pos").join(scores.select("query_id", "id", "score"), ["query_id", "id"], "left").fillna(0.0, ["score"])
    return out if ranks is None else out.join(ranks.select("query_id", "id", F.col("score").alias("rank_score")), ["query_id", "id"], "left")


def score_ranges(rows: DataFrame) -> DataFrame:
    """(query_id, range): the least and the greatest score of each query as text, to four digits; N/A without scores."""
    shown = F.format_string("[%.4f, %.4f]", F.min("score"), F.max("score"))
    return rows.groupBy("query_id").agg(F.when(F.count("score") > 0, shown).otherwise("N/A").alias("range"))


def picked_by_index(candidates: DataFrame, picks: DataFrame, most: int) -> DataFrame:
    """(query_id, id, place): candidates that a model names by exactly their index, each once, at most ``most``.

    ``candidates`` has query_id, id and pos (from 0), ``picks`` query_id and picks
    (array<string>); what is no index of a candidate is ignored.
    """
    named = picks.select("query_id", F.posexplode("picks").alias("at", "pick")).select("query_id", "at", F.trim("pick").alias("pick"))
    met = candidates.withColumn("pick", F.col("pos").cast("string")).join(named, ["query_id", "pick"])
    return _first_picks(met, most)


def picked_by_line(candidates: DataFrame, picks: DataFrame, most: int) -> DataFrame:
    """(query_id, id, place): candidates that a model names by lines ``[index] text``.

    An index that is no candidate's is corrected by the text behind the bracket, to the
    first candidate with that text; lines without brackets are ignored. ``candidates`` has
    query_id, id, pos and text.
    """
    line = F.col("line")
    split = picks.select("query_id", F.posexplode("picks").alias("at", "line")).where(F.contains(line, F.lit("[")) & F.contains(line, F.lit("]")))
    inside = F.trim(F.regexp_extract(line, r"^[^\[]*\[([^\]]*)\]", 1))
    rest = F.trim(F.regexp_extract(line, r"(?s)^[^\]]*\](.*)$", 1))
    named = split.select("query_id", "at", inside.alias("pick"), rest.alias("line_text"))
    known = candidates.select("query_id", F.col("pos").cast("string").alias("pick"), F.col("id").alias("by_index"))
    texts = candidates.groupBy("query_id", F.trim("text").alias("line_text")).agg(F.min_by("id", "pos").alias("by_text"))
    met = named.join(known, ["query_id", "pick"], "left").join(texts, ["query_id", "line_text"], "left")
    return _first_picks(met.select("query_id", "at", F.coalesce("by_index", "by_text").alias("id")).where("id is not null"), most)


def _first_picks(met: DataFrame, most: int) -> DataFrame:
    once = met.groupBy("query_id", "id").agg(F.min("at").alias("at"))
    return per_key_limit(once, ["query_id"], [F.col("at"), F.col("id")], most).select("query_id", "id", "place")


def native_fill(sections: DataFrame, native: DataFrame, most: int) -> DataFrame:
    """(query_id, place, chunk_id, is_fill): the sections, then native hits whose chunk is not there yet, up to ``most``.

    Both have query_id, chunk_id and place; a chunk that comes twice counts at its first place.
    """
    tiers = [t.select("query_id", "chunk_id", F.lit(i).alias("tier"), F.col("place").alias("at")) for i, t in enumerate((sections, native))]
    first = tiers[0].unionByName(tiers[1]).groupBy("query_id", "chunk_id").agg(F.min(F.struct("tier", "at")).alias("b"))
    placed = per_key_limit(first, ["query_id"], [F.col("b.tier"), F.col("b.at"), F.col("chunk_id")], most)
    return placed.select("query_id", "place", "chunk_id", (F.col("b.tier") == 1).alias("is_fill"))
