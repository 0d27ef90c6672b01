"""Hops over the bipartite graph of events and entities, for all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.operators.filters import per_key_limit
from mnemograph.operators.knn import cosine, score_of_cosine
from mnemograph.session import cut


def edges_of(events: DataFrame, event: str = "event_id", entities: str = "entity_ids") -> DataFrame:
    """(event_id, entity_id), each edge once; null lists and null ids give none."""
    return events.select(F.col(event).alias("event_id"), F.explode(entities).alias("entity_id")).where("entity_id is not null").distinct()


def events_of_entities(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, entity_id, event_id) for seeds (query_id, entity_id); says nothing about deletion."""
    return seeds.select("query_id", "entity_id").distinct().join(edges, "entity_id").select("query_id", "entity_id", "event_id")


def entities_of_events(seeds: DataFrame, edges: DataFrame, n: int | None = None) -> DataFrame:
    """(query_id, event_id, entity_id) ordered by ids; with ``n`` the first n of each query."""
    found = seeds.select("query_id", "event_id").distinct().join(edges, "event_id").select("query_id", "event_id", "entity_id")
    return found if n is None else per_key_limit(found, ["query_id"], [F.col("event_id"), F.col("entity_id")], n)


def capped_pairs(seeds: DataFrame, edges: DataFrame, cap: int, exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, entity_id, event_id): at most ``cap`` events of each entity by id, without excluded ones."""
    found = events_of_entities(seeds, edges)
    if exclude is not None:
        found = found.join(exclude.select("query_id", "event_id").distinct(), ["query_id", "event_id"], "left_anti")
    return per_key_limit(found, ["query_id", "entity_id"], [F.col("event_id")], cap).select("query_id", "entity_id", "event_id")


def with_entities(pairs: DataFrame) -> DataFrame:
    """(query_id, event_id, entity_ids): the entities that led to an event, in order."""
    return pairs.groupBy("query_id", "event_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))


def next_entities(scored: DataFrame, edges: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """(query_id, entity_id, from_event): new entities of scored events, by their best event, at most ``most``."""
    reached = scored.join(edges, "event_id").join(seen.select("query_id", "entity_id").distinct(), ["query_id", "entity_id"], "left_anti")
    best = reached.groupBy("query_id", "entity_id").agg(F.min(F.struct((-F.round("score", 9)).alias("cost"), "event_id")).alias("b"))
    ranked = per_key_limit(best, ["query_id"], [F.col("b.cost"), F.col("entity_id")], most)
    return ranked.select("query_id", "entity_id", F.col("b.event_id").alias("from_event"))


def trace_back(answers: DataFrame, routes: DataFrame, depth: int) -> DataFrame:
    """Route rows from which the answers (query_id, node) can be reached, walking backwards.

    ``routes`` has query_id, from_node, to_node and others; at most ``depth`` steps, each a
    join against what was not visited yet, so cycles end.
    """
    frontier = answers.select("query_id", F.col("node").alias("to_node")).distinct()
    visited = frontier
    kept = None
    for _ in range(depth):
        step = routes.join(frontier, ["query_id", "to_node"], "left_semi")
        kept = step if kept is None else kept.unionByName(step)
        sources = step.select("query_id", F.col("from_node").alias("to_node")).distinct()
        frontier = cut(sources.join(visited, ["query_id", "to_node"], "left_anti"))
        visited = cut(visited.unionByName(frontier))
    return kept.distinct()


def node_degrees(edges: DataFrame, a: str = "event_id", b: str = "entity_id") -> DataFrame:
    """(node, kind, degree) of the bipartite graph."""
    left = edges.groupBy(F.col(a).cast("string").alias("node")).agg(F.count(F.lit(1)).alias("degree")).withColumn("kind", F.lit(a))
    right = edges.groupBy(F.col(b).cast("string").alias("node")).agg(F.count(F.lit(1)).alias("degree")).withColumn("kind", F.lit(b))
    return left.unionByName(right).select("node", "kind", "degree")


def bipartite_metrics(edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row of graph statistics; ``components`` has node and component."""
    degrees = node_degrees(edges)
    by_degree = degrees.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.sum(F.when(F.col("kind") == "event_id", 1).otherwise(0)).alias("n_events"),
        F.sum(F.when(F.col("kind") == "entity_id", 1).otherwise(0)).alias("n_entities"),
        (F.sum("degree") / 2).cast("bigint").alias("n_edges"),
        F.round(F.avg("degree"), 6).alias("mean_degree"),
        F.max("degree").alias("max_degree"),
        *(F.sum(F.when(F.col("degree") > d, 1).otherwise(0)).alias(f"degree_over_{d}") for d in (1, 2, 3)),
    )
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    by_size = sizes.agg(
        F.count(F.lit(1)).alias("n_components"), F.max("size").alias("giant_size"), F.round(F.avg("size"), 6).alias("mean_size"),
        F.percentile("size", F.lit(0.5)).alias("median_size"), F.round(F.exp(F.avg(F.log("size"))), 6).alias("geometric_size"),
        F.round(F.count(F.lit(1)) / F.sum(1 / F.col("size")), 6).alias("harmonic_size"),
    )
    both = by_degree.withColumn("_k", F.lit(1)).join(by_size.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each
    n = F.col("n_nodes")
    return both.withColumn("density", F.when(n > 1, F.round(2 * F.col("n_edges") / (n * (n - 1)), 9)).otherwise(0.0))


def degree_distribution(edges: DataFrame, most: int = 20) -> DataFrame:
    """(degree, n): the most frequent degrees, the report's top list."""
    return node_degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "degree").limit(most)


def triangles(edges: DataFrame, u: str = "src", v: str = "dst") -> DataFrame:
    """(node, triangles) of an undirected graph, each edge directed from the smaller degree.

    Directing by degree bounds the out-degree by the square root of twice the edges, so a
    hub never meets all its neighbours pairwise.
    """
    plain = edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).where("a < b").distinct()
    degree = plain.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    da, db = degree.withColumnsRenamed({"node": "a", "d": "da"}), degree.withColumnsRenamed({"node": "b", "d": "db"})
    ranked = plain.join(da, "a").join(db, "b")
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = cut(ranked.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedges = out.select("x", F.col("y").alias("p")).join(out.select("x", F.col("y").alias("q")), "x").where("p < q")
    closed = wedges.join(plain.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"])
    return closed.select(F.explode(F.array("x", "p", "q")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def route_rows(rows: DataFrame, method: str, hop: int, from_kind: str, to_kind: str) -> DataFrame:
    """Route rows of one stage from (query_id, from_node, to_node, score)."""
    return rows.select("query_id", F.col("from_node").cast("string"), F.col("to_node").cast("string"), F.lit(from_kind).alias("from_kind"), F.lit(to_kind).alias("to_kind"), F.lit(method).alias("method"), F.lit(hop).alias("hop"), "score")


def distinct_routes(routes: DataFrame) -> DataFrame:
    """Each (from, to, method, hop) of a query once, with its best score, in route order."""
    keys = ["query_id", "from_node", "to_node", "from_kind", "to_kind", "method", "hop"]
    once = routes.groupBy(*keys).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("hop", "from_node", "to_node", "method")
    return once.withColumn("position", F.row_number().over(order))


def relations_of(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(event_id, entity_id, vec): edges with the vector of what ties the entity to the event."""
    return edges.join(vectors.select(F.col("id").alias("event_id"), "vec"), "event_id").select("event_id", "entity_id", "vec")


def near_relations(queries: DataFrame, within: DataFrame, relations: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """(query_id, event_id, entity_id, score, place): the k relations most similar to the query, over the threshold.

    Only relations of the query's events in ``within`` (query_id, event_id) take part. The
    threshold is applied to the k best, so it never lets a lower one in.
    """
    pairs = within.select("query_id", "event_id").distinct().join(relations, "event_id")
    asked = queries.select("query_id", F.col("vec").alias("_q"))
    scored = pairs.join(asked, "query_id").withColumn("score", score_of_cosine(cosine(F.col("_q"), F.col("vec"))))
    best = per_key_limit(scored.drop("_q", "vec"), ["query_id"], [F.desc(F.round("score", 9)), F.col("event_id"), F.col("entity_id")], k)
    return best.where(F.col("score") >= threshold)


def related_entities(queries: DataFrame, events: DataFrame, relations: DataFrame, seen: DataFrame, most: int, multiplier: int = 5, threshold: float = 0.0) -> DataFrame:
    """(query_id, entity_id, event_id, score, place): new entities by the similarity of their relations.

    Of the ``most`` x ``multiplier`` nearest relations of the query's events those of new
    entities count; the first ``most`` entities are kept with all their kept relations.
    """
    near = near_relations(queries, events, relations, most * multiplier, threshold)
    new = near.join(seen.select("query_id", "entity_id").distinct(), ["query_id", "entity_id"], "left_anti")
    first = new.groupBy("query_id", "entity_id").agg(F.min("place").alias("first"))
    kept = per_key_limit(first, ["query_id"], [F.col("first")], most, "n").select("query_id", "entity_id")
    return new.join(kept, ["query_id", "entity_id"], "left_semi")


def scope_edges(scope: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, event_id, entity_id): the edges of each query's scope (query_id, id, score), at most ``most`` of them."""
    found = scope.select("query_id", F.col("id").alias("event_id")).join(edges, "event_id").select("query_id", "event_id", "entity_id")
    return found if most is None else per_key_limit(found, ["query_id"], [F.col("event_id"), F.col("entity_id")], most).select("query_id", "event_id", "entity_id")


def scoped_pairs(seeds: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """(query_id, entity_id, event_id): at most ``cap`` events of each entity within the query's own edges."""
    met = seeds.select("query_id", "entity_id").distinct().join(edges, ["query_id", "entity_id"])
    return per_key_limit(met, ["query_id", "entity_id"], [F.col("event_id")], cap).select("query_id", "entity_id", "event_id")


def scoped_entities(events: DataFrame, edges: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """(query_id, entity_id): new entities of events (query_id, id, score) within the query's own edges, best events first."""
    met = events.select("query_id", F.col("id").alias("event_id"), "score").join(edges, ["query_id", "event_id"])
    new = met.join(seen.select("query_id", "entity_id").distinct(), ["query_id", "entity_id"], "left_anti")
    first = new.groupBy("query_id", "entity_id").agg(F.min(F.struct((-F.round("score", 9)).alias("cost"), "event_id")).alias("b"))
    return per_key_limit(first, ["query_id"], [F.col("b.cost"), F.col("b.event_id"), F.col("entity_id")], most).select("query_id", "entity_id")


def endpoints_within(edges: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose event and entity both belong: two semi-joins."""
    return edges.join(events.select("event_id").distinct(), "event_id", "left_semi").join(entities.select("entity_id").distinct(), "entity_id", "left_semi").select("event_id", "entity_id")


def clues(routes: DataFrame, level: str = "final") -> DataFrame:
    """(query_id, from_node, to_node, stage, level, score, hop): each step of the routes once, at its best score."""
    once = routes.groupBy("query_id", "from_node", "to_node", F.col("method").alias("stage")).agg(F.max_by(F.struct("score", "hop"), F.struct("score", (-F.col("hop")).alias("h"))).alias("b"))
    return once.select("query_id", "from_node", "to_node", "stage", F.lit(level).alias("level"), "b.score", "b.hop")


def clue_nodes(routes: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, node, kind, name): every node of the routes once; ``names`` has node, kind and name."""
    ends = [routes.select("query_id", F.col(f"{end}_node").alias("node"), F.col(f"{end}_kind").alias("kind")) for end in ("from", "to")]
    return ends[0].unionByName(ends[1]).distinct().join(names, ["node", "kind"], "left")
