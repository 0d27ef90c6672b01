"""Queries of the plans that end with a model's choice, of scoped search and of the rank dispatch.

The tables hold no replies of models. Where a plan needs one, the query derives it from its
own candidates by a fixed rule, which the SQL repeats: the model names the candidates of the
query's category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.operators import bm25, filters, graph, ranking
from mnemograph.operators.knn import exact_knn
from mnemograph.plans import retrieval
from mnemograph.plans.config import PRECISE, GraphConfig, PickConfig, ScopeConfig
from mnemograph.queries.registry import query
from mnemograph.queries.retrieval import _SCORE, BM25_SQL, EVENT_TYPES, EVENTS_SQL, FLAT_SQL, RELATED_SQL, TITLES_SQL, _best, _setting, title_vectors
from mnemograph.session import cut, table

def _own_category(candidates: DataFrame, events: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates of their query's category, with their titles: what the model names."""
    titled = candidates.join(events.select(F.col("event_id").alias("id"), "title", "category"), "id")
    return titled.join(queries.select("query_id", "grp"), "query_id").where((F.col("category") == F.col("grp")) & F.col("title").isNotNull())


_SECTIONS_SQL = """
chunk AS (SELECT article_id, arg_min(chunk_id, {'r': chunk_rank, 'i': chunk_id}) AS chunk_id FROM chunk_draft WHERE article_id IS NOT NULL GROUP BY article_id),
both_hits AS (SELECT 0 AS tier, query_id, id, place FROM picked UNION ALL SELECT 1, query_id, id, place FROM native),
hit AS (SELECT h.tier, h.query_id, h.id, h.place, c.chunk_id FROM both_hits h JOIN ev ON ev.event_id = h.id JOIN chunk c ON c.article_id = ev.source_id),
once AS (SELECT *, row_number() OVER (PARTITION BY tier, query_id ORDER BY place, id) AS spot FROM
  (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY tier, query_id, chunk_id ORDER BY place, id) = 1) QUALIFY spot <= CASE tier WHEN 0 THEN 10 ELSE 20 END),
first AS (SELECT query_id, chunk_id, min({'tier': tier, 'spot': spot}) AS b FROM once GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY b, chunk_id) AS place, chunk_id, b.tier = 1 AS is_fill FROM first QUALIFY place <= 10"""


def _picking_sql(vectors: str, seeds: str, entity_events: int, hop_events: int, max_events: int) -> str:
    new = f"SELECT DISTINCT n.query_id, e.event_id AS id FROM new_entity n JOIN edge e USING (entity_id) ANTI JOIN start s ON s.query_id = n.query_id AND s.id = e.event_id"
    capped = _best(new, hop_events, "id", "n") if hop_events else f"({new})"
    return f"""
near AS (SELECT q.query_id, v.event_id AS id, {_SCORE.format(v="v")} AS score FROM q, {vectors} v),
by_entity AS {_best(f"SELECT n.* FROM (SELECT DISTINCT s.query_id, e.event_id AS id FROM {seeds} s JOIN edge e USING (entity_id)) p JOIN near n USING (query_id, id)", entity_events)},
by_vector AS {_best("SELECT * FROM near WHERE score >= 0.4", 20)},
start AS (SELECT query_id, id FROM by_entity UNION SELECT query_id, id FROM by_vector),
new_entity AS (SELECT DISTINCT s.query_id, e.entity_id FROM start s JOIN edge e ON e.event_id = s.id ANTI JOIN {seeds} x ON x.query_id = s.query_id AND x.entity_id = e.entity_id),
new_event AS {capped},
candidate AS (SELECT query_id, id, score, place - 1 AS pos FROM {_best("SELECT near.* FROM (SELECT query_id, id FROM start UNION SELECT query_id, id FROM new_event) JOIN near USING (query_id, id)", max_events)}),
named AS (SELECT c.query_id, c.id, c.pos, ev.title FROM candidate c JOIN ev ON ev.event_id = c.id JOIN q USING (query_id) WHERE ev.category = q.grp AND ev.title IS NOT NULL),
native AS {_best(f"SELECT q.query_id, ev.event_id AS id, {_SCORE.format(v='ev')} AS score FROM q, ev", 20)}"""


@query(f"""WITH {EVENTS_SQL}, {TITLES_SQL}, {_picking_sql("tv", "seed", 20, 0, 1000)},
by_text AS (SELECT query_id, trim(title) AS t, arg_min(id, pos) AS id FROM candidate JOIN ev ON ev.event_id = candidate.id WHERE title IS NOT NULL GROUP BY ALL),
chosen AS (SELECT n.query_id, CASE WHEN n.pos % 3 = 2 THEN b.id ELSE n.id END AS id, min(n.pos) AS score FROM named n LEFT JOIN by_text b ON b.query_id = n.query_id AND b.t = trim(n.title) GROUP BY ALL),
picked AS {_best("SELECT * FROM chosen", 5, "score, id")}, {_SECTIONS_SQL}""")
def q3_atomic(spark, sf_dir):
    """Title vectors, uncapped expansion, a model's lines, plain hits to fill up.

    Every third line has a wrong index and is found by its text.
    """
    events, queries, seeds, edges, content = _setting(spark, sf_dir)
    titles = title_vectors(spark, sf_dir, events)
    candidates = cut(retrieval.picking_candidates(queries, seeds, edges, titles, PickConfig(), **EVENT_TYPES))
    index = F.when(F.col("pos") % 3 == 2, "?").otherwise(F.col("pos").cast("string"))
    lines = _own_category(candidates, events, queries).select("query_id", "pos", F.concat(F.lit("["), index, F.lit("] "), "title").alias("line"))
    picks = lines.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("picks"))
    texts = candidates.join(events.select(F.col("event_id").alias("id"), F.col("title").alias("text")), "id")
    picked = ranking.picked_by_line(texts, picks, 5)
    native = exact_knn(queries, content.select("id", "vec"), 20, **EVENT_TYPES)
    return retrieval.picked_sections(picked, native, events, table(spark, sf_dir, "chunk_draft"), 10)


_NAME_SEEDS_SQL = f"""
body AS (SELECT entity_id AS id, 'name' AS field, name AS text FROM (SELECT entity_id, arg_max(name, updated_time) AS name FROM sag2_entity GROUP BY 1)),
question AS (SELECT query_id, text FROM q), {BM25_SQL},
name_seed AS (SELECT query_id, id AS entity_id FROM {_best("SELECT query_id, id, max(s) AS score FROM by_field GROUP BY ALL", 20)})"""


@query(f"""WITH {EVENTS_SQL}, {_NAME_SEEDS_SQL}, {_picking_sql("ev", "name_seed", 40, 2000, 100)},
picked AS {_best("SELECT query_id, id, pos AS score FROM named", 5, "score, id")}, {_SECTIONS_SQL}""")
def q5_precise(spark, sf_dir):
    """Entities by their names' words, content vectors, a model's indices.

    The model's list has each index twice and numbers that are no candidate's.
    """
    events, queries, _, edges, content = _setting(spark, sf_dir)
    names = filters.latest(table(spark, sf_dir, "sag2_entity").select("entity_id", "name", "updated_time"), "entity_id", "updated_time")
    found = bm25.search(queries.select("query_id", "text"), bm25.Index(names, "entity_id", ["name"]), {"name": 1.0})
    seeds = cut(ranking.top(found, PRECISE.entity_top_k).select("query_id", F.col("id").alias("entity_id")))
    vectors = content.select("id", "vec")
    candidates = cut(retrieval.picking_candidates(queries, seeds, edges, vectors, PRECISE, **EVENT_TYPES))
    own = _own_category(candidates, events, queries).groupBy("query_id").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    picks = own.select("query_id", F.flatten(F.transform("at", lambda p: F.array(p.cast("string"), F.lit("99999"), F.concat(F.lit(" "), p.cast("string"))))).alias("picks"))
    picked = ranking.picked_by_index(candidates, picks, PRECISE.pick_top_k)
    native = exact_knn(queries, vectors, 20, **EVENT_TYPES)
    return retrieval.picked_sections(picked, native, events, table(spark, sf_dir, "chunk_draft"), 10)


_SCOPE_SQL = f"""
scope AS (SELECT query_id, id, score FROM {_best(f"SELECT q.query_id, ev.event_id AS id, {_SCORE.format(v='ev')} AS score FROM q, ev", 1000)}),
inside AS (SELECT s.query_id, e.event_id, e.entity_id FROM scope s JOIN edge e ON e.event_id = s.id),
path_a AS (SELECT query_id, id, score FROM {_best("SELECT * FROM scope", 20)} WHERE score >= 0.3),
pair_b AS (SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY i.query_id, i.entity_id ORDER BY i.event_id) AS n FROM inside i JOIN seed s ON s.query_id = i.query_id AND s.entity_id = i.entity_id) WHERE n <= 10),
path_b AS (SELECT DISTINCT s.query_id, s.id, s.score FROM pair_b b JOIN scope s ON s.query_id = b.query_id AND s.id = b.event_id WHERE s.score >= 0.3),
recalled AS (SELECT * FROM path_a UNION SELECT * FROM path_b),
front AS (SELECT query_id, id, score FROM {_best("SELECT * FROM recalled", 15)}), {RELATED_SQL},
hop_entity AS (SELECT DISTINCT r.query_id, r.entity_id FROM related r JOIN inside i ON i.query_id = r.query_id AND i.event_id = r.event_id AND i.entity_id = r.entity_id),
hop_pair AS (SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY i.query_id, i.entity_id ORDER BY i.event_id) AS n FROM inside i SEMI JOIN hop_entity h ON h.query_id = i.query_id AND h.entity_id = i.entity_id) WHERE n <= 50),
hop_new AS (SELECT * FROM {_best("SELECT DISTINCT s.query_id, s.id, s.score FROM hop_pair p JOIN scope s ON s.query_id = p.query_id AND s.id = p.event_id ANTI JOIN recalled r ON r.query_id = s.query_id AND r.id = s.id", 50)} WHERE score >= 0.4),
found AS (SELECT query_id, id, score FROM recalled UNION ALL SELECT query_id, id, score FROM hop_new)"""


def _scoped(spark: SparkSession, sf_dir: str):
    events, queries, seeds, edges, content = _setting(spark, sf_dir)
    relations = graph.relations_of(edges, title_vectors(spark, sf_dir, events))
    return events, queries, seeds, cut(retrieval.scoped_candidates(queries, seeds, edges, content.select("id", "vec"), relations, ScopeConfig(), **EVENT_TYPES))


@query(f"WITH {EVENTS_SQL}, {TITLES_SQL}, {_SCOPE_SQL} SELECT query_id, id, round(score, 6) AS score, place FROM {_best('SELECT * FROM found', 100)}")
def q7_scoped(spark, sf_dir):
    """Recall and expansion inside each query's own subgraph."""
    best = _scoped(spark, sf_dir)[3]
    return ranking.top(best, 100).withColumn("score", F.round("score", 6))


_LISTED_SQL = f"listed AS (SELECT query_id, id, score, place - 1 AS pos FROM {_best('SELECT * FROM found', 100)})"
_MODEL_SCORE = "CAST('0x' || id[7:8] AS BIGINT)"
_RERANK_SQL = f"""
model AS (SELECT query_id, id, CASE WHEN {_MODEL_SCORE} % 4 = 1 THEN NULL ELSE {_MODEL_SCORE} / 255 END AS m FROM listed WHERE {_MODEL_SCORE} % 2 = 1),
heard AS (SELECT DISTINCT query_id FROM model WHERE m IS NOT NULL),
head AS (SELECT l.query_id, l.id, 0 AS tier, -m.m AS cost, l.pos, row_number() OVER (PARTITION BY l.query_id ORDER BY m.m DESC, l.pos) AS n FROM listed l JOIN model m USING (query_id, id) WHERE m.m >= 0 QUALIFY n <= 10),
rest AS (SELECT l.query_id, l.id, 1 AS tier, CASE WHEN h.query_id IS NULL THEN 0 ELSE -l.score END AS cost, l.pos FROM listed l LEFT JOIN heard h USING (query_id) ANTI JOIN head x ON x.query_id = l.query_id AND x.id = l.id WHERE h.query_id IS NULL OR l.score >= 0.3),
reranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY tier, cost, pos) AS place, tier = 1 AS is_fill FROM (SELECT query_id, id, tier, cost, pos FROM head UNION ALL SELECT * FROM rest) QUALIFY place <= 10)"""
_REPLIED_SQL = """
said AS (SELECT l.query_id, l.pos FROM listed l JOIN ev ON ev.event_id = l.id JOIN q USING (query_id) WHERE ev.category = q.grp AND ev.title IS NOT NULL),
spoken AS (SELECT DISTINCT query_id FROM said),
replied AS (SELECT l.query_id, l.id, row_number() OVER (PARTITION BY l.query_id ORDER BY s.pos IS NULL, -s.pos, l.pos) AS place, s.pos IS NULL AS is_fill, k.query_id IS NULL AS failed
  FROM listed l LEFT JOIN said s ON s.query_id = l.query_id AND s.pos = l.pos LEFT JOIN spoken k ON k.query_id = l.query_id
  WHERE s.pos IS NOT NULL OR k.query_id IS NULL OR l.score >= 0.3 QUALIFY place <= 10)"""


def _model_scores(best: DataFrame) -> DataFrame:
    """Scores of a rerank model for every second candidate, by its id; a part of them is no number."""
    number = F.conv(F.substring("id", 7, 2), 16, 10).cast("int")
    score = F.when(number % 4 == 1, F.lit(float("nan"))).otherwise(number / 255)
    return best.where(number % 2 == 1).select("query_id", "id", score.alias("score"))


def _replies(listed: DataFrame, events: DataFrame, queries: DataFrame) -> DataFrame:
    """A reply that names the candidates of the query's category, the last first, in square brackets."""
    own = _own_category(listed, events, queries).groupBy("query_id").agg(F.sort_array(F.collect_list("pos"), asc=False).alias("at"))
    text = F.array_join(F.transform("at", lambda p: F.concat(F.lit("["), p.cast("string"), F.lit("]"))), " then ")
    return own.select("query_id", F.concat(F.lit("Best: "), text, F.lit(" and [123456]")).alias("reply"))


def _listed(best: DataFrame) -> DataFrame:
    return ranking.top(best, 100).select("query_id", "id", "score", (F.col("place") - 1).alias("pos"))


@query(f"WITH {EVENTS_SQL}, {TITLES_SQL}, {_SCOPE_SQL}, {_LISTED_SQL}, {_RERANK_SQL} SELECT * FROM reranked")
def r8_rerank_fill(spark, sf_dir):
    """A rerank model's best, then the most similar."""
    best = _scoped(spark, sf_dir)[3]
    return ranking.rerank_fill(_listed(best), _model_scores(best), 10, 10, 0.3)


@query(f"WITH {EVENTS_SQL}, {TITLES_SQL}, {_SCOPE_SQL}, {_LISTED_SQL}, {_REPLIED_SQL} SELECT * FROM replied")
def r9_reply_fill(spark, sf_dir):
    """Candidates named in a reply, then others in order."""
    events, queries, _, best = _scoped(spark, sf_dir)
    listed = _listed(best)
    return ranking.reply_fill(listed, _replies(listed, events, queries), 10, 0.3)


@query(f"""WITH {EVENTS_SQL}, {TITLES_SQL}, {_SCOPE_SQL}, {_LISTED_SQL}, {_RERANK_SQL}, {_REPLIED_SQL},
body AS (SELECT event_id AS id, 'title' AS field, title AS text FROM ev UNION ALL SELECT event_id, 'content', content FROM ev),
question AS (SELECT query_id, text FROM q), {BM25_SQL},
words AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS r2 FROM
  (SELECT f.query_id, f.id, max(f.s * CASE f.field WHEN 'title' THEN 2 ELSE 1 END) AS s FROM by_field f JOIN listed b ON b.query_id = f.query_id AND b.id = f.id GROUP BY ALL)),
fused AS {_best("SELECT b.query_id, b.id, 1 / (61 + b.pos) + 1 / (60 + coalesce(w.r2, 1 + count(*) OVER (PARTITION BY b.query_id))) AS score FROM listed b LEFT JOIN words w USING (query_id, id)", 10)}
SELECT 'rerank' AS strategy, query_id, id, place, is_fill FROM reranked UNION ALL SELECT 'llm_rank', query_id, id, place, is_fill FROM replied
UNION ALL SELECT 'rrf', query_id, id, place, false FROM fused""")
def r10_rank_dispatch(spark, sf_dir):
    """The same candidates ranked by each strategy, with what is only filled up marked."""
    events, queries, _, best = _scoped(spark, sf_dir)
    listed = _listed(best)
    words = bm25.search(queries.select("query_id", "text"), bm25.Index(events, "event_id", ["title", "content"]), {"title": 2.0, "content": 1.0}, among=best)
    config = GraphConfig()
    parts = [
        retrieval.rank_events(best, "rerank", config, model=_model_scores(best)), retrieval.rank_events(best, "llm_rank", config, replies=_replies(listed, events, queries)),
        retrieval.rank_events(best, "rrf", config, words=words),
    ]
    named = [p.select(F.lit(s).alias("strategy"), "query_id", "id", "place", "is_fill") for s, p in zip(("rerank", "llm_rank", "rrf"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(f"""WITH {EVENTS_SQL}, {TITLES_SQL}, front AS (SELECT query_id, event_id AS id FROM (SELECT DISTINCT s.query_id, e.event_id FROM seed s JOIN edge e USING (entity_id))), {RELATED_SQL}
SELECT query_id, event_id, entity_id, round(score, 6) AS score, place FROM rel_top""")
def k4_near_relations(spark, sf_dir):
    """Of the relations of the query's events the 45 most similar over 0.45."""
    events, queries, seeds, edges, _ = _setting(spark, sf_dir)
    relations = graph.relations_of(edges, title_vectors(spark, sf_dir, events))
    reached = graph.events_of_entities(seeds, edges).select("query_id", "event_id")
    return graph.near_relations(queries, reached, relations, 45, 0.45).withColumn("score", F.round("score", 6))


@query(f"""WITH {EVENTS_SQL}, {TITLES_SQL}, front AS (SELECT query_id, event_id AS id FROM (SELECT DISTINCT s.query_id, e.event_id FROM seed s JOIN edge e USING (entity_id))), {RELATED_SQL}
SELECT query_id, entity_id, event_id, round(score, 6) AS score, place FROM related""")
def k10_related_entities(spark, sf_dir):
    """New entities by the similarity of their relations, with all their kept relations."""
    events, queries, seeds, edges, _ = _setting(spark, sf_dir)
    relations = graph.relations_of(edges, title_vectors(spark, sf_dir, events))
    reached = graph.events_of_entities(seeds, edges).select("query_id", "event_id")
    return graph.related_entities(queries, reached, relations, seeds, 15, 3, 0.45).select("query_id", "entity_id", "event_id", F.round("score", 6).alias("score"), "place")


@query(f"""WITH near AS (SELECT CAST(q.vec_id // 50 // 3 AS BIGINT) AS query_id, CAST(q.vec_id // 50 % 3 AS INTEGER) AS part, v.vec_id AS id,
  {FLAT_SQL.format(a="CAST(q.embedding AS DOUBLE[])", b="CAST(v.embedding AS DOUBLE[])")} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
hit AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY round(score, 9) DESC, id) AS place FROM near WHERE score >= 0.5 QUALIFY place <= 20),
once AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY part, place) = 1)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY part, place) - 1 AS pos FROM once""")
def k9_entity_matches(spark, sf_dir):
    """K9: queries of three vectors; what several of them find counts at the first."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    number = F.floor(F.col("id") / 50)
    asked = e.where("id % 50 = 0").select(F.floor(number / 3).cast("bigint").alias("query_id"), (number % 3).cast("int").alias("part"), "vec")
    return retrieval.entity_matches(asked, e, 20, 0.5).withColumn("score", F.round("score", 6))


@query(f"""WITH {EVENTS_SQL}, {TITLES_SQL}, {_SCOPE_SQL} SELECT query_id, (SELECT count(*) FROM scope s WHERE s.query_id = q.query_id) AS scope_events,
  (SELECT count(*) FROM inside i WHERE i.query_id = q.query_id) AS scope_edges, (SELECT count(DISTINCT entity_id) FROM inside i WHERE i.query_id = q.query_id) AS scope_entities,
  coalesce((SELECT printf('[%.4f, %.4f]', min(score), max(score)) FROM scope s WHERE s.query_id = q.query_id), 'N/A') AS range FROM q""")
def a31_scope_statistics(spark, sf_dir):
    """The sizes of each query's scope and the range of its scores."""
    _, queries, _, edges, content = _setting(spark, sf_dir)
    scope = cut(exact_knn(queries, content.select("id", "vec"), 1000, **EVENT_TYPES).select("query_id", "id", "score"))
    inside = graph.scope_edges(scope, edges)
    by_edge = inside.groupBy("query_id").agg(F.count(F.lit(1)).alias("scope_edges"), F.countDistinct("entity_id").alias("scope_entities"))
    sizes = scope.groupBy("query_id").agg(F.count(F.lit(1)).alias("scope_events"))
    joined = queries.select("query_id").join(sizes, "query_id", "left").join(by_edge, "query_id", "left").join(ranking.score_ranges(scope), "query_id", "left")
    return joined.fillna(0, ["scope_events", "scope_edges", "scope_entities"]).fillna("N/A", ["range"])


@query(f"""WITH {EVENTS_SQL}, asked AS (SELECT query_id, unnest(entity_ids) AS entity_id, unnest(range(len(entity_ids))) AS pos FROM q),
scored AS (SELECT query_id, entity_id, min(pos) AS pos FROM asked WHERE entity_id IS NOT NULL GROUP BY ALL)
SELECT s.query_id, s.entity_id AS id, CAST(s.pos AS INTEGER) AS pos, coalesce(w.weight, 0) AS score FROM scored s LEFT JOIN (SELECT entity_id, arg_max(weight, updated_time) AS weight FROM sag2_entity WHERE weight IS NOT NULL GROUP BY 1) w USING (entity_id)""")
def f22_ranked_results(spark, sf_dir):
    """The entities of each query in their order, with their weights, 0 where there is none."""
    _, queries, _, _, _ = _setting(spark, sf_dir)
    listed = queries.select("query_id", F.posexplode("entity_ids").alias("pos", "id"))
    ids = ranking.ordered_union([listed, listed]).select("query_id", "id").join(listed.groupBy("query_id", "id").agg(F.min("pos").alias("pos")), ["query_id", "id"])
    weights = filters.latest(table(spark, sf_dir, "sag2_entity").where("weight is not null").select("entity_id", "updated_time", "weight"), "entity_id", "updated_time")
    scores = queries.select("query_id", F.explode("entity_ids").alias("entity_id")).distinct().join(weights, "entity_id").select("query_id", F.col("entity_id").alias("id"), F.col("weight").alias("score"))
    return ranking.ranked_results(ids, scores)


@query(f"""WITH {EVENTS_SQL}, source AS (SELECT source_config_id AS s, count(*) AS n FROM sag2_entity GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
own AS (SELECT DISTINCT entity_id FROM sag2_entity WHERE source_config_id = (SELECT s FROM source)), mine AS (SELECT event_id FROM ev WHERE category = 'research' OR category IS NULL)
SELECT event_id, entity_id FROM edge WHERE event_id IN (SELECT event_id FROM mine) AND entity_id IN (SELECT entity_id FROM own)""")
def j19_edges_within(spark, sf_dir):
    """Edges whose event is of the given categories and whose entity is of the largest source."""
    events, _, _, edges, _ = _setting(spark, sf_dir)
    entities = table(spark, sf_dir, "sag2_entity")
    largest = entities.groupBy("source_config_id").count().orderBy(F.desc("count"), "source_config_id").limit(1)
    own = entities.join(largest, "source_config_id", "left_semi")
    return graph.endpoints_within(edges, events.where("category = 'research' or category is null"), own)


def _latest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.latest(table(spark, sf_dir, "sag2_entity").select("entity_id", "name", "updated_time"), "entity_id", "updated_time")


@query(f"""WITH {EVENTS_SQL}, {TITLES_SQL}, latest AS (SELECT entity_id, arg_max(name, updated_time) AS name FROM sag2_entity GROUP BY 1),
near AS (SELECT query_id, id, score, place FROM {_best(f"SELECT q.query_id, ev.event_id AS id, {_SCORE.format(v='ev')} AS score FROM q, ev WHERE ev.event_id <> q.query_id", 3)} WHERE score >= 0.7),
named AS (SELECT n.query_id, n.id, e.entity_id, l.name, row_number() OVER (PARTITION BY n.query_id, n.id ORDER BY e.entity_id) AS k FROM near n JOIN edge e ON e.event_id = n.id JOIN latest l USING (entity_id))
SELECT n.query_id, n.id, n.place, round(n.score, 6) AS score, coalesce(list(named.name ORDER BY named.entity_id) FILTER (named.name IS NOT NULL), []) AS names
FROM near n LEFT JOIN named ON named.query_id = n.query_id AND named.id = n.id AND named.k <= 10 GROUP BY ALL""")
def j21_related_events(spark, sf_dir):
    """The three most similar events at or over 0.7, with at most ten of their entities each."""
    _, queries, _, edges, content = _setting(spark, sf_dir)
    near = cut(exact_knn(queries, content.select("id", "vec"), 3, threshold=0.7, skip_self=True, **EVENT_TYPES))
    named = near.select("query_id", "id").join(edges.withColumnRenamed("event_id", "id"), "id").join(_latest_names(spark, sf_dir), "entity_id")
    few = filters.per_key_limit(named, ["query_id", "id"], [F.col("entity_id")], 10, "k")
    listed = few.where("name is not null").groupBy("query_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "name"))), lambda x: x["name"]).alias("names"))
    empty = F.array().cast("array<string>")
    return near.join(listed, ["query_id", "id"], "left").select("query_id", "id", "place", F.round("score", 6).alias("score"), F.coalesce("names", empty).alias("names"))
