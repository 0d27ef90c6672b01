"""Query plans: one lazy DataFrame for all queries of a batch, keyed by query_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.operators import bm25, graph, ranking
from mnemograph.operators.filters import at_least, per_key_limit
from mnemograph.operators.knn import exact_knn, score_pairs
from mnemograph.plans.config import FastConfig, GraphConfig, KeywordConfig, PickConfig, ScopeConfig, VectorConfig
from mnemograph.session import cut


def vector_search(queries: DataFrame, vectors: DataFrame, config: VectorConfig = VectorConfig(), **types) -> DataFrame:
    """(query_id, id, score, place): the most similar rows over the threshold."""
    return exact_knn(queries, vectors, config.top_k, threshold=config.similarity_threshold, **types)


def keyword_search(queries: DataFrame, index: bm25.Index, boosts: dict[str, float], config: KeywordConfig = KeywordConfig()) -> DataFrame:
    """(query_id, id, score, place): the best BM25 scores; blank queries find nothing."""
    found = bm25.search(queries, index, boosts).where(F.col("score") >= config.least_score)
    return ranking.top(found, config.top_k)


def hydrate(ranked: DataFrame, events: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(query_id, place, event_id, chunk_id, heading, content): each chunk once, at its best event.

    An event's chunk is the first of its article; events without a chunk are dropped, null
    texts are empty.
    """
    first = chunks.where("article_id is not null").groupBy("article_id").agg(F.min_by(F.struct("chunk_id", "heading", "content"), F.struct("chunk_rank", "chunk_id")).alias("c"))
    sections = ranked.select("query_id", F.col("id").alias("event_id"), F.col("place").alias("at")).join(events.select("event_id", F.col("source_id").alias("article_id")), "event_id").join(first, "article_id")
    once = ranking.first_of_each(sections, ["query_id", "c.chunk_id"], [F.col("at"), F.col("event_id")])
    placed = per_key_limit(once, ["query_id"], [F.col("at"), F.col("event_id")], most)
    text = lambda f: F.coalesce(f"c.{f}", F.lit("")).alias(f)
    return placed.select("query_id", "place", "event_id", F.col("c.chunk_id").alias("chunk_id"), text("heading"), text("content"))


def two_channel(queries: DataFrame, seeds: DataFrame, edges: DataFrame, vectors: DataFrame, config: FastConfig = FastConfig(), **types) -> DataFrame:
    """(query_id, id, score, from_entity, from_vector, touches_seed, fast_score): entity hits and vector hits in one list."""
    reached = graph.events_of_entities(seeds, edges).select("query_id", F.col("event_id").alias("id")).distinct()
    by_entity = ranking.top(score_pairs(reached, queries, vectors), config.entity_events)
    by_vector = exact_knn(queries, vectors, config.multi_top_k * 3, threshold=config.similarity_threshold, **types).where(F.col("place") <= config.multi_top_k)
    merged = ranking.merge_max([by_entity, by_vector])
    marks = ranking.channel_merge(by_entity, by_vector).select("query_id", "id", "from_entity", "from_vector")
    touching = reached.withColumn("touches_seed", F.lit(True))
    marked = merged.join(marks, ["query_id", "id"]).join(touching, ["query_id", "id"], "left").fillna(False, ["touches_seed"])
    return ranking.fast_score(marked)


def fast_search(queries: DataFrame, seeds: DataFrame, edges: DataFrame, vectors: DataFrame, config: FastConfig = FastConfig(), **types) -> DataFrame:
    """(query_id, id, score, place): seeds by the fast score, their expansion, all by the vector score."""
    scored = cut(two_channel(queries, seeds, edges, vectors, config, **types))
    first = per_key_limit(scored, ["query_id"], [ranking.by_score("fast_score"), F.col("id")], config.seed_events).select("query_id", "id", "score")
    found, frontier = first, first
    for _ in range(config.max_hops):
        entities = graph.entities_of_events(frontier.withColumnRenamed("id", "event_id"), edges).select("query_id", "entity_id")
        events = graph.events_of_entities(entities, edges).select("query_id", F.col("event_id").alias("id")).distinct()
        new = events.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
        frontier = cut(ranking.top(score_pairs(new, queries, vectors), config.max_events).select("query_id", "id", "score"))
        found = found.unionByName(frontier)
    return ranking.top(found, config.max_events)


def graph_recall(queries: DataFrame, seeds: DataFrame, edges: DataFrame, vectors: DataFrame, config: GraphConfig, **types) -> tuple[DataFrame, DataFrame]:
    """Events by the query vector and by the query's entities, scored, and their routes."""
    by_vector = exact_knn(queries, vectors, config.query_events, threshold=config.score_threshold, **types).select("query_id", "id", "score")
    pairs = graph.capped_pairs(seeds, edges, config.events_per_entity)
    reached = pairs.select("query_id", F.col("event_id").alias("id")).distinct()
    by_entity = score_pairs(reached, queries, vectors).where(at_least(F.col("score"), config.score_threshold)).select("query_id", "id", "score")
    routes = [
        graph.route_rows(by_vector.select("query_id", F.col("query_id").alias("from_node"), F.col("id").alias("to_node"), "score"), "event_vector", 0, "query", "event"),
        graph.route_rows(seeds.select("query_id", F.col("query_id").alias("from_node"), F.col("entity_id").alias("to_node"), F.lit(1.0).alias("score")), "entity_match", 0, "query", "entity"),
        graph.route_rows(
            pairs.join(by_entity.withColumnRenamed("id", "event_id"), ["query_id", "event_id"]).select("query_id", F.col("entity_id").alias("from_node"), F.col("event_id").alias("to_node"), "score"),
            "entity_to_event", 0, "entity", "event",
        ),
    ]
    return ranking.merge_max([by_vector, by_entity]), reduce(DataFrame.unionByName, routes)


def graph_search(
    queries: DataFrame, seeds: DataFrame, edges: DataFrame, vectors: DataFrame, config: GraphConfig = GraphConfig(), keyword: bm25.Index | None = None, boosts: dict[str, float] | None = None,
    relations: DataFrame | None = None, **types
) -> tuple[DataFrame, DataFrame]:
    """Recall, expansion over shared entities and fused ranking: (query_id, id, score, place) and the routes.

    ``queries`` has query_id, vec and text, ``seeds`` query_id and entity_id, ``edges``
    event_id and entity_id, ``vectors`` id and vec. A hop's events are scored against the
    query; a greater score of another way is never lowered. Entities of the query count as
    seen, even those without events. With ``relations`` (event_id, entity_id, vec) the new
    entities of a hop are those of the relations most similar to the query, else those of
    the best events.
    """
    best, routes = graph_candidates(queries, seeds, edges, vectors, config, relations, **types)
    if keyword is None:
        return ranking.top(best, config.max_results), routes
    words = bm25.search(queries, keyword, boosts or {}, among=best)
    return ranking.reciprocal_rank_fusion(best, words, config.rrf_k, config.max_results), routes


def _reached_entities(queries: DataFrame, frontier: DataFrame, edges: DataFrame, relations: DataFrame | None, seen: DataFrame, config: GraphConfig) -> DataFrame:
    """(query_id, entity_id, from_event): the next hop's entities, with each event that leads to one."""
    if relations is None:
        return graph.next_entities(frontier, edges, seen, config.entities_per_hop)
    found = graph.related_entities(queries, frontier, relations, seen, config.entities_per_hop, config.relation_multiplier, config.relation_threshold)
    return found.select("query_id", "entity_id", F.col("event_id").alias("from_event"))


def graph_candidates(
    queries: DataFrame, seeds: DataFrame, edges: DataFrame, vectors: DataFrame, config: GraphConfig, relations: DataFrame | None = None, **types
) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score) of the best events of recall and expansion, and the routes to them."""
    recalled, routes = graph_recall(queries, seeds, edges, vectors, config, **types)
    found = cut(recalled)
    seen = seeds.select("query_id", "entity_id")
    frontier = ranking.top(found, config.seed_events).select("query_id", F.col("id").alias("event_id"), "score")
    for hop in range(1, config.max_hops + 1):
        entities = cut(_reached_entities(queries, frontier, edges, relations, seen, config))
        seen = seen.unionByName(entities.select("query_id", "entity_id"))
        pairs = graph.capped_pairs(entities, edges, config.events_per_entity, found.withColumnRenamed("id", "event_id"))
        scored = score_pairs(pairs.select("query_id", F.col("event_id").alias("id")).distinct(), queries, vectors)
        kept = ranking.top(scored, config.events_per_hop).where(at_least(F.col("score"), config.event_threshold))
        new = cut(kept.select("query_id", "id", "score"))
        routes = routes.unionByName(graph.route_rows(entities.select("query_id", F.col("from_event").alias("from_node"), F.col("entity_id").alias("to_node"), F.lit(1.0).alias("score")), "event_to_entity", hop, "event", "entity"))
        via = pairs.join(new.withColumnRenamed("id", "event_id"), ["query_id", "event_id"])
        routes = routes.unionByName(graph.route_rows(via.select("query_id", F.col("entity_id").alias("from_node"), F.col("event_id").alias("to_node"), "score"), "expand_to_event", hop, "entity", "event"))
        found = cut(ranking.merge_max([found, new]))
        frontier = new.withColumnRenamed("id", "event_id")
    return ranking.top(found, config.ranked_events).select("query_id", "id", "score"), graph.distinct_routes(routes)


def rank_events(best: DataFrame, strategy: str, config: GraphConfig = GraphConfig(), words: DataFrame | None = None, model: DataFrame | None = None, replies: DataFrame | None = None) -> DataFrame:
    """(query_id, id, place, is_fill): the best events by one of the strategies rrf, rerank and llm_rank.

    ``words`` are keyword scores (query_id, id, score), ``model`` scores of a rerank model,
    ``replies`` a language model's choices (query_id, reply). What only fills up, because
    the model gave too little, is ``is_fill``; the others are for display.
    """
    if strategy == "rrf":
        fused = ranking.reciprocal_rank_fusion(best, words, config.rrf_k, config.max_results)
        return fused.select("query_id", "id", "place", F.lit(False).alias("is_fill"))
    listed = ranking.top(best, config.ranked_events).withColumn("pos", F.col("place") - 1).drop("place")
    if strategy == "rerank":
        return ranking.rerank_fill(listed, model, config.rerank_top_k, config.max_results, config.fill_threshold)
    if strategy == "llm_rank":
        return ranking.reply_fill(listed, replies, config.max_results, config.fill_threshold).drop("failed")
    raise ValueError(f"no such strategy: {strategy}")


def scoped_candidates(
    queries: DataFrame, seeds: DataFrame, edges: DataFrame, vectors: DataFrame, relations: DataFrame, config: ScopeConfig = ScopeConfig(), **types
) -> DataFrame:
    """(query_id, id, score): recall and expansion within a subgraph of each query.

    The scope is the query's ``event_top_k`` most similar events of ``vectors`` and their
    edges; both recall paths and every hop stay inside it. The first new entities come by
    relation similarity, whose limit is taken before the scope cuts.
    """
    scope = cut(exact_knn(queries, vectors, config.event_top_k, **types).select("query_id", "id", "score"))
    inside = cut(graph.scope_edges(scope, edges, config.scope_edges or None))
    with_score = lambda pairs: pairs.select("query_id", F.col("event_id").alias("id")).distinct().join(scope, ["query_id", "id"])
    by_vector = ranking.top(scope, config.query_events).where(at_least(F.col("score"), config.score_threshold)).select("query_id", "id", "score")
    by_entity = with_score(graph.scoped_pairs(seeds, inside, config.events_per_entity)).where(at_least(F.col("score"), config.score_threshold))
    found = cut(ranking.merge_max([by_vector, by_entity]))
    seen = seeds.select("query_id", "entity_id").distinct()
    first = ranking.top(found, config.seed_events).select("query_id", F.col("id").alias("event_id"))
    related = graph.related_entities(queries, first, relations, seen, config.entities_per_hop, config.relation_multiplier, config.relation_threshold)
    entities = cut(related.join(inside, ["query_id", "event_id", "entity_id"], "left_semi").select("query_id", "entity_id").distinct())
    for _ in range(config.max_hops):
        seen = seen.unionByName(entities)
        reached = with_score(graph.scoped_pairs(entities, inside, config.events_per_hop)).join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
        new = cut(ranking.top(reached, config.events_per_hop).where(at_least(F.col("score"), config.event_threshold)).select("query_id", "id", "score"))
        found = cut(ranking.merge_max([found, new]))
        entities = cut(graph.scoped_entities(new, inside, seen, config.entities_per_hop))
    return ranking.top(found, config.ranked_events).select("query_id", "id", "score")


def picking_candidates(queries: DataFrame, seeds: DataFrame, edges: DataFrame, vectors: DataFrame, config: PickConfig = PickConfig(), **types) -> DataFrame:
    """(query_id, id, score, pos): what a model picks from, by similarity; ``pos`` counts from 0.

    Two channels, by the query's entities and by its vector, are expanded over entities not
    seen before; all events found are ranked by their vector and cut to ``max_events``.
    """
    reached = graph.events_of_entities(seeds, edges).select("query_id", F.col("event_id").alias("id")).distinct()
    by_entity = ranking.top(score_pairs(reached, queries, vectors), config.entity_events).select("query_id", "id", "score")
    by_vector = exact_knn(queries, vectors, config.multi_top_k, threshold=config.similarity_threshold, **types).select("query_id", "id", "score")
    found = cut(ranking.merge_max([by_entity, by_vector]).select("query_id", "id"))
    seen, frontier = seeds.select("query_id", "entity_id").distinct(), found
    for _ in range(config.max_hops):
        entities = graph.entities_of_events(frontier.withColumnRenamed("id", "event_id"), edges).select("query_id", "entity_id").distinct()
        entities = cut(entities.join(seen, ["query_id", "entity_id"], "left_anti"))
        seen = seen.unionByName(entities)
        events = graph.events_of_entities(entities, edges).select("query_id", F.col("event_id").alias("id")).distinct()
        new = events.join(found, ["query_id", "id"], "left_anti")
        if config.hop_events:
            new = per_key_limit(new, ["query_id"], [F.col("id")], config.hop_events).select("query_id", "id")
        frontier = cut(new)
        found = found.unionByName(frontier)
    best = ranking.top(score_pairs(found, queries, vectors), config.max_events)
    return best.select("query_id", "id", "score", (F.col("place") - 1).alias("pos"))


def picked_sections(picked: DataFrame, native: DataFrame, events: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(query_id, place, chunk_id, is_fill): the chunks of picked events, filled up with those of a plain search.

    Both rankings have query_id, id and place.
    """
    chosen, plain = (hydrate(r, events, chunks, n) for r, n in ((picked, most), (native, 2 * most)))
    return ranking.native_fill(chosen, plain, most)


def entity_matches(queries: DataFrame, entities: DataFrame, k: int, threshold: float, **types) -> DataFrame:
    """(query_id, id, score, pos): entities near to any of a query's vectors, each at its first vector.

    ``queries`` has query_id, part (the number of the vector) and vec. Of every vector the
    ``k`` nearest at or over the threshold count; the first vector that finds an entity
    gives its score, and the order is by vector, then by rank.
    """
    keyed = queries.withColumn("q", F.struct("query_id", "part"))
    plain = keyed.select(F.to_json("q").alias("query_id"), "vec", *(["grp"] if types.get("group_type") else []))
    near = exact_knn(plain, entities, k, threshold=threshold, **{**types, "query_type": "string"})
    named = near.join(keyed.select(F.to_json("q").alias("key"), "q"), near.query_id == F.col("key")).select("q.query_id", "q.part", "id", "score", "place")
    once = ranking.first_of_each(named, ["query_id", "id"], [F.col("part"), F.col("place")])
    return per_key_limit(once, ["query_id"], [F.col("part"), F.col("place")], 1 << 30, "n").select("query_id", "id", "score", (F.col("n") - 1).alias("pos"))
