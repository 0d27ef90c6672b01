"""Queries of the retrieval operators and plans over events, entities, chunks and vectors.

Query sets are the rows whose id is divisible by 50, searched against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.operators import bm25, filters, graph, ranking
from mnemograph.operators.components import connected_components
from mnemograph.operators.knn import exact_knn, score_pairs
from mnemograph.plans import retrieval
from mnemograph.plans.config import GraphConfig, VectorConfig
from mnemograph.queries.registry import query
from mnemograph.session import table

EVENT_TYPES = {"id_type": "string", "query_type": "string"}
FLAT_SQL = "(1 + list_cosine_similarity({a}, {b})) / 2"

# the latest usable delivery of each event, the query events, and the edges
EVENTS_SQL = """
event AS (
  SELECT event_id, arg_max(e, created_time) AS e FROM (SELECT event_id, created_time, e FROM event_vectors e) GROUP BY event_id
),
ev AS (
  SELECT event_id, e.source_id AS source_id, e.title AS title, e.content AS content, e.category AS category, e.entity_ids AS entity_ids,
    e.start_time AS start_time, e.end_time AS end_time, e.created_time AS created_time, CAST(e.content_vector AS DOUBLE[]) AS vec
  FROM event WHERE NOT coalesce(e.is_delete, false) AND len(e.content_vector) = 128
    AND len(list_filter(e.content_vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e.content_vector, lambda x: x <> 0)) > 0
),
q AS (SELECT event_id AS query_id, vec, title AS text, category AS grp, entity_ids FROM ev WHERE CAST('0x' || event_id[1:8] AS BIGINT) % 50 = 0),
edge AS (SELECT DISTINCT event_id, x AS entity_id FROM (SELECT event_id, unnest(entity_ids) AS x FROM ev) WHERE x IS NOT NULL),
seed AS (SELECT DISTINCT query_id, x AS entity_id FROM (SELECT query_id, unnest(entity_ids) AS x FROM q) WHERE x IS NOT NULL)"""


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest delivery of each event that is not deleted and has a usable content vector."""
    rows = filters.latest(table(spark, sf_dir, "event_vectors").drop("title_vector", "tags"), "event_id", "created_time")
    v = F.col("content_vector")
    usable = filters.not_deleted(F.col("is_delete")) & filters.finite_vector(v, 128) & F.exists(v, lambda x: x != 0)
    return rows.where(usable).withColumn("vec", v.cast("array<double>")).drop("content_vector")


def query_events(events: DataFrame) -> DataFrame:
    chosen = F.conv(F.substring("event_id", 1, 8), 16, 10).cast("bigint") % 50 == 0
    return events.where(chosen).select(F.col("event_id").alias("query_id"), "vec", F.col("title").alias("text"), F.col("category").alias("grp"), "entity_ids")


def _setting(spark: SparkSession, sf_dir: str):
    events = live_events(spark, sf_dir)
    queries = query_events(events)
    seeds = queries.select("query_id", F.explode("entity_ids").alias("entity_id")).where("entity_id is not null").distinct()
    return events, queries, seeds, graph.edges_of(events), events.select(F.col("event_id").alias("id"), "vec", F.col("category").alias("grp"))


_FLAT = "SELECT q.vec_id AS query_id, v.vec_id AS id, (1 + list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) / 2 AS score, q.label = v.label AS same FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM ({})"


@query(f"SELECT query_id, id, round(score, 6) AS score, place FROM ({_RANKED.format(_FLAT + ' AND score >= 0.4')}) WHERE place <= 20")
def q1_vector_search(spark, sf_dir):
    """The 20 most similar vectors over 0.4."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = e.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return retrieval.vector_search(queries, e, VectorConfig()).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, id, round(score, 6) AS score, place FROM ({_RANKED.format(_FLAT + ' AND same AND q.vec_id <> v.vec_id')}) WHERE place <= 5")
def k3_knn_same_type(spark, sf_dir):
    """Neighbours of the same type, the row itself left out."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("grp"))
    queries = e.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return exact_knn(queries, e, 5, group_type="int", skip_self=True).withColumn("score", F.round("score", 6))


@query(f"""WITH {EVENTS_SQL} SELECT query_id, id, round(score, 6) AS score, place FROM ({_RANKED.format("SELECT query_id, event_id AS id, " + FLAT_SQL.format(a="q.vec", b="ev.vec") + " AS score FROM q, ev WHERE q.query_id <> ev.event_id")}) WHERE place <= 10""")
def k2_knn_events(spark, sf_dir):
    """Live events most similar to the query events."""
    _, queries, _, _, vectors = _setting(spark, sf_dir)
    return exact_knn(queries, vectors, 10, skip_self=True, **EVENT_TYPES).withColumn("score", F.round("score", 6))


@query(f"""WITH {EVENTS_SQL}, pair AS (SELECT DISTINCT s.query_id, e.event_id AS id FROM seed s JOIN edge e USING (entity_id))
SELECT query_id, id, round(score, 6) AS score, place FROM ({_RANKED.format("SELECT p.query_id, p.id, " + FLAT_SQL.format(a="q.vec", b="ev.vec") + " AS score FROM pair p JOIN q USING (query_id) JOIN ev ON ev.event_id = p.id")}) WHERE place <= 50""")
def k7_coarse_rank(spark, sf_dir):
    """The events of the query's entities by similarity; a join, no search."""
    _, queries, seeds, edges, vectors = _setting(spark, sf_dir)
    pairs = graph.events_of_entities(seeds, edges).select("query_id", F.col("event_id").alias("id")).distinct()
    return ranking.top(score_pairs(pairs, queries, vectors), 50).select("query_id", "id", F.round("score", 6).alias("score"), "place")


BM25_SQL = r"""
field_words AS (SELECT id, field, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM body WHERE text IS NOT NULL),
field_stats AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM field_words WHERE len(w) > 0 GROUP BY field),
posting AS (SELECT id, field, len(w) AS dl, t AS term, count(*) AS tf FROM (SELECT id, field, w, unnest(w) AS t FROM field_words) GROUP BY ALL),
freq AS (SELECT field, term, count(*) AS df FROM posting GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, t AS term FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM question WHERE trim(text) <> '')),
by_field AS (
  SELECT query_id, id, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) AS s
  FROM asked JOIN posting USING (term) JOIN freq USING (field, term) JOIN field_stats USING (field) GROUP BY ALL
)"""


@query(f"""WITH body AS (SELECT chunk_id AS id, 'heading' AS field, heading AS text FROM chunk_draft UNION ALL SELECT chunk_id, 'content', content FROM chunk_draft),
question AS (SELECT id AS query_id, question AS text FROM eval_samples), {BM25_SQL}
SELECT query_id, id, round(score, 6) AS score, place FROM ({_RANKED.format("SELECT query_id, id, max(s) AS score FROM by_field GROUP BY ALL")}) WHERE place <= 20""")
def q2_keyword_search(spark, sf_dir):
    """BM25 of heading or content for every question."""
    chunks = table(spark, sf_dir, "chunk_draft")
    questions = table(spark, sf_dir, "eval_samples").select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    found = retrieval.keyword_search(questions, bm25.Index(chunks, "chunk_id", ["heading", "content"]), {"heading": 1.0, "content": 1.0})
    return found.withColumn("score", F.round("score", 6))


@query(f"""WITH body AS (SELECT idx AS id, 'title' AS field, title AS text FROM sample_corpus UNION ALL SELECT idx, 'text', text FROM sample_corpus),
question AS (SELECT id AS query_id, question AS text FROM eval_samples), {BM25_SQL}
SELECT query_id, id, round(score, 6) AS score, place FROM ({_RANKED.format("SELECT query_id, id, max(s * CASE field WHEN 'title' THEN 3 ELSE 1 END) AS score FROM by_field GROUP BY ALL")}) WHERE place <= 10""")
def t4_boosted_search(spark, sf_dir):
    """BM25 with a boosted title over the corpus."""
    index = bm25.Index(table(spark, sf_dir, "sample_corpus"), "idx", ["title", "text"])
    questions = table(spark, sf_dir, "eval_samples").select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    return ranking.top(bm25.search(questions, index, {"title": 3.0, "text": 1.0}), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH body AS (SELECT entity_id AS id, 'name' AS field, name AS text FROM (SELECT entity_id, arg_max(name, updated_time) AS name FROM sag2_entity GROUP BY 1)),
question AS (SELECT id AS query_id, question AS text FROM eval_samples), {BM25_SQL}
SELECT query_id, id, round(score, 6) AS score, place FROM ({_RANKED.format("SELECT query_id, id, max(s) AS score FROM by_field GROUP BY ALL")}) WHERE place <= 20""")
def t2_entity_search(spark, sf_dir):
    """Entities by the words of their names."""
    names = filters.latest(table(spark, sf_dir, "sag2_entity").select("entity_id", "name", "updated_time"), "entity_id", "updated_time")
    questions = table(spark, sf_dir, "eval_samples").select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    return ranking.top(bm25.search(questions, bm25.Index(names, "entity_id", ["name"]), {"name": 1.0}), 20).withColumn("score", F.round("score", 6))


@query("""
WITH asked AS (SELECT id AS query_id, list_filter(string_split_regex(trim(lower(a)), '\\s+'), lambda w: w <> '') AS words FROM (SELECT id, array_to_string(answer, ' ') AS a FROM eval_samples WHERE len(answer) > 0)),
body AS (SELECT idx AS id, lower(concat_ws(' ', coalesce(title, ''), coalesce(text, ''))) AS body FROM sample_corpus),
counted AS (SELECT query_id, id, w, CAST((length(body) - length(replace(body, w, ''))) / length(w) AS BIGINT) AS n FROM (SELECT query_id, unnest(words) AS w FROM asked), body WHERE contains(body, w))
SELECT query_id, id, CAST(sum(n) AS BIGINT) AS score FROM counted GROUP BY ALL HAVING sum(n) > 0
""")
def t7_substring_score(spark, sf_dir):
    """How often an answer's words occur in each record of the corpus."""
    asked = table(spark, sf_dir, "eval_samples").where(F.size("answer") > 0).select(F.col("id").alias("query_id"), F.array_join("answer", " ").alias("text"))
    return bm25.substring_score(asked, table(spark, sf_dir, "sample_corpus"), "idx", ["title", "text"])


@query("""
WITH latest AS (SELECT entity_id, arg_max(name, updated_time) AS name FROM sag2_entity GROUP BY 1)
SELECT subject AS token, entity_id, name FROM (SELECT DISTINCT lower(subject) AS subject FROM subject_areas) JOIN latest ON contains(lower(name), subject)
""")
def f14_name_contains(spark, sf_dir):
    """entities whose name holds the name of a subject."""
    names = filters.latest(table(spark, sf_dir, "sag2_entity").select("entity_id", "name", "updated_time"), "entity_id", "updated_time").where("name is not null")
    asked = table(spark, sf_dir, "subject_areas").select(F.lower("subject").alias("token"))
    return filters.containing(names, "entity_id", "name", asked, "token").join(names.select("entity_id", "name"), "entity_id").withColumnRenamed("needle", "token")


@query("""
WITH said AS (SELECT id AS query_id, list_concat([lower(trim(question))], list_filter(string_split_regex(lower(trim(question)), '\\s+'), lambda w: length(w) >= 2)) AS l FROM eval_samples WHERE question IS NOT NULL),
asked AS (SELECT query_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:8] AS tokens FROM said),
latest AS (SELECT entity_id, arg_max(name, updated_time) AS name FROM sag2_entity WHERE entity_type = 'subject' GROUP BY 1), token AS (SELECT query_id, unnest(tokens) AS t FROM asked)
SELECT query_id, entity_id, list_sort(list(DISTINCT t)) AS tokens FROM token JOIN latest ON contains(lower(name), t) WHERE t <> '' GROUP BY ALL
""")
def f14_like_any_token(spark, sf_dir):
    """subject entities whose name holds a question, or any of its words; at most eight tokens of a question."""
    e = table(spark, sf_dir, "sag2_entity").where("entity_type = 'subject'").select("entity_id", "name", "updated_time")
    names = filters.latest(e, "entity_id", "updated_time").where("name is not null")
    questions = table(spark, sf_dir, "eval_samples").where("question is not null")
    tokens = questions.select(F.col("id").alias("query_id"), F.explode(filters.name_tokens(F.col("question"))).alias("token"))
    met = filters.containing(names, "entity_id", "name", tokens, "token").withColumnRenamed("needle", "token")
    return tokens.join(met, "token").groupBy("query_id", "entity_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))


@query("""
SELECT event_id, created_time, start_time, end_time FROM event_vectors
WHERE (end_time IS NOT NULL AND start_time <= TIMESTAMP '2024-09-30' AND end_time >= TIMESTAMP '2024-03-01')
   OR (end_time IS NULL AND start_time BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-09-30')
""")
def f6_time_overlap(spark, sf_dir):
    """events whose interval meets seven months."""
    from mnemograph.functions.dates import overlaps

    low, high = (F.lit(t).cast("timestamp_ntz") for t in ("2024-03-01 00:00:00", "2024-09-30 00:00:00"))
    e = table(spark, sf_dir, "event_vectors")
    return e.where(overlaps(F.col("start_time"), F.col("end_time"), low, high)).select("event_id", "created_time", "start_time", "end_time")


@query(f"""WITH {EVENTS_SQL}, hit AS (SELECT s.query_id, s.entity_id, e.event_id, row_number() OVER (PARTITION BY s.query_id, s.entity_id ORDER BY e.event_id) AS n
  FROM seed s JOIN edge e USING (entity_id) WHERE e.event_id <> s.query_id)
SELECT query_id, event_id, list_sort(list(DISTINCT entity_id)) AS entity_ids FROM hit WHERE n <= 3 GROUP BY ALL""")
def j3_capped_pairs(spark, sf_dir):
    """At most three other events of each query entity."""
    _, queries, seeds, edges, _ = _setting(spark, sf_dir)
    own = queries.select("query_id", F.col("query_id").alias("event_id"))
    return graph.with_entities(graph.capped_pairs(seeds, edges, 3, exclude=own))


@query(f"""WITH {EVENTS_SQL} SELECT q.query_id, e.event_id, count(*) AS n_shared, list_sort(list(e.entity_id)) AS shared
FROM seed q JOIN edge e USING (entity_id) WHERE e.event_id <> q.query_id GROUP BY ALL""")
def f8_shared_entities(spark, sf_dir):
    """Events that share entities with the query event, through the edges."""
    _, _, seeds, edges, _ = _setting(spark, sf_dir)
    met = graph.events_of_entities(seeds, edges).where(F.col("event_id") != F.col("query_id"))
    return met.groupBy("query_id", "event_id").agg(F.count(F.lit(1)).alias("n_shared"), F.array_sort(F.collect_list("entity_id")).alias("shared"))


@query(f"""WITH {EVENTS_SQL}, last AS (SELECT entity_id, arg_max(name, updated_time) AS name, arg_max(entity_type, updated_time) AS kind FROM sag2_entity GROUP BY 1)
SELECT ev.event_id, ev.title, list(last.name ORDER BY last.entity_id) AS names, count(*) AS n_entities
FROM ev JOIN edge USING (event_id) JOIN last USING (entity_id) WHERE last.name IS NOT NULL GROUP BY ALL""")
def j15_event_relations(spark, sf_dir):
    """Events with the names of their entities."""
    events, _, _, edges, _ = _setting(spark, sf_dir)
    names = filters.latest(table(spark, sf_dir, "sag2_entity").select("entity_id", "name", "updated_time"), "entity_id", "updated_time").where("name is not null")
    joined = edges.join(names, "entity_id").join(events.select("event_id", "title"), "event_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "name"))), lambda x: x["name"])
    return joined.groupBy("event_id", "title").agg(ordered.alias("names"), F.count(F.lit(1)).alias("n_entities"))


_TWO_SQL = f"""
near AS (SELECT q.query_id, ev.event_id AS id, {FLAT_SQL.format(a="q.vec", b="ev.vec")} AS score FROM q, ev),
vec_hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM near WHERE score >= 0.4) WHERE n <= 20),
ent_hit AS (SELECT * FROM (SELECT n.query_id, n.id, n.score, row_number() OVER (PARTITION BY n.query_id ORDER BY round(n.score, 9) DESC, n.id) AS n
  FROM (SELECT DISTINCT s.query_id, e.event_id AS id FROM seed s JOIN edge e USING (entity_id)) p JOIN near n USING (query_id, id)) WHERE n <= 20),
merged AS (SELECT query_id, id, max(score) AS score, max(e) = 1 AS from_entity, max(v) = 1 AS from_vector FROM
  (SELECT query_id, id, score, 1 AS e, 0 AS v FROM ent_hit UNION ALL SELECT query_id, id, score, 0, 1 FROM vec_hit) GROUP BY ALL),
touched AS (SELECT DISTINCT s.query_id, e.event_id AS id, true AS touches_seed FROM seed s JOIN edge e USING (entity_id)),
spread AS (SELECT m.*, coalesce(t.touches_seed, false) AS touches_seed, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM merged m LEFT JOIN touched t USING (query_id, id)),
fast AS (SELECT query_id, id, score, from_entity, from_vector, touches_seed, 0.85 * CASE WHEN hi - lo <= 1e-9 THEN 1 ELSE (score - lo) / (hi - lo) END
  + CASE WHEN touches_seed THEN 0.15 ELSE 0 END + CASE WHEN from_entity AND from_vector THEN 0.05 ELSE 0 END AS fast_score FROM spread)"""


@query(f"WITH {EVENTS_SQL}, {_TWO_SQL} SELECT query_id, id, round(score, 6) AS score, from_entity, from_vector, touches_seed, round(fast_score, 6) AS fast_score FROM fast")
def r5_two_channel(spark, sf_dir):
    """Entity and vector hits in one list with the fast score."""
    _, queries, seeds, edges, vectors = _setting(spark, sf_dir)
    out = retrieval.two_channel(queries, seeds, edges, vectors, **EVENT_TYPES)
    return out.withColumns({"score": F.round("score", 6), "fast_score": F.round("fast_score", 6)})


@query(f"""WITH {EVENTS_SQL}, {_TWO_SQL},
seed_event AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fast_score, 9) DESC, id) AS n FROM fast) WHERE n <= 20),
hop AS (SELECT DISTINCT s.query_id, e2.event_id AS id FROM seed_event s JOIN edge e1 ON e1.event_id = s.id JOIN edge e2 ON e2.entity_id = e1.entity_id),
fresh AS (SELECT h.query_id, h.id, n.score FROM hop h JOIN near n USING (query_id, id) ANTI JOIN seed_event s ON s.query_id = h.query_id AND s.id = h.id),
found AS (SELECT query_id, id, score FROM seed_event UNION ALL SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM fresh) WHERE n <= 100)
SELECT query_id, id, round(score, 6) AS score, place FROM ({_RANKED.format("SELECT * FROM found")}) WHERE place <= 100""")
def q4_fast_search(spark, sf_dir):
    """Two channels, expansion over entities, final order by similarity."""
    _, queries, seeds, edges, vectors = _setting(spark, sf_dir)
    return retrieval.fast_search(queries, seeds, edges, vectors, **EVENT_TYPES).withColumn("score", F.round("score", 6))


_SCORE = FLAT_SQL.format(a="q.vec", b="{v}.vec")
#: title vectors of the live events; they stand for the vectors of an entity's relation to its event
TITLES_SQL = """
tv AS (SELECT event_id, CAST(e.title_vector AS DOUBLE[]) AS vec FROM event WHERE event_id IN (SELECT event_id FROM ev) AND len(e.title_vector) = 128
  AND len(list_filter(e.title_vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e.title_vector, lambda x: x <> 0)) > 0)"""


def title_vectors(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    rows = filters.latest(table(spark, sf_dir, "event_vectors").select("event_id", "created_time", "title_vector"), "event_id", "created_time")
    v = F.col("title_vector")
    usable = filters.finite_vector(v, 128) & F.exists(v, lambda x: x != 0)
    return rows.where(usable).join(events.select("event_id"), "event_id", "left_semi").select(F.col("event_id").alias("id"), v.cast("array<double>").alias("vec"))


def _best(rows: str, n: int, order: str = "round(score, 9) DESC, id", place: str = "place") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS {place} FROM ({rows}) QUALIFY {place} <= {n})"


#: K10 over a front (query_id, id) of events: new entities by relation similarity, and their relations
RELATED_SQL = f"""
rel_near AS (SELECT f.query_id, e.event_id, e.entity_id, {_SCORE.format(v="tv")} AS score FROM front f JOIN edge e ON e.event_id = f.id JOIN tv ON tv.event_id = e.event_id JOIN q USING (query_id)),
rel_top AS (SELECT * FROM {_best("SELECT * FROM rel_near", 45, "round(score, 9) DESC, event_id, entity_id")} WHERE score >= 0.45),
rel_new AS (SELECT r.* FROM rel_top r ANTI JOIN seed s ON s.query_id = r.query_id AND s.entity_id = r.entity_id),
rel_first AS {_best("SELECT query_id, entity_id, min(place) AS spot FROM rel_new GROUP BY ALL", 15, "spot", "n")},
related AS (SELECT r.query_id, r.entity_id, r.event_id, r.score, r.place FROM rel_new r SEMI JOIN rel_first f ON f.query_id = r.query_id AND f.entity_id = r.entity_id)"""
_GRAPH_SQL = f"""
near AS (SELECT q.query_id, ev.event_id AS id, {FLAT_SQL.format(a="q.vec", b="ev.vec")} AS score FROM q, ev),
path_a AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM near WHERE score >= 0.3) WHERE n <= 20),
pair_b AS (SELECT query_id, entity_id, event_id FROM (SELECT s.query_id, s.entity_id, e.event_id, row_number() OVER (PARTITION BY s.query_id, s.entity_id ORDER BY e.event_id) AS n
  FROM seed s JOIN edge e USING (entity_id)) WHERE n <= 10),
path_b AS (SELECT DISTINCT b.query_id, b.event_id AS id, n.score FROM pair_b b JOIN near n ON n.query_id = b.query_id AND n.id = b.event_id WHERE n.score >= 0.3),
recalled AS (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM path_a UNION ALL SELECT * FROM path_b) GROUP BY ALL),
front AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM recalled) WHERE n <= 15),
{RELATED_SQL},
ent AS (SELECT DISTINCT query_id, entity_id FROM related),
pair_x AS (SELECT query_id, entity_id, event_id FROM (SELECT t.query_id, t.entity_id, e.event_id, row_number() OVER (PARTITION BY t.query_id, t.entity_id ORDER BY e.event_id) AS n
  FROM ent t JOIN edge e USING (entity_id) ANTI JOIN recalled r ON r.query_id = t.query_id AND r.id = e.event_id) WHERE n <= 10),
new_event AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM
  (SELECT DISTINCT p.query_id, p.event_id AS id, n.score FROM pair_x p JOIN near n ON n.query_id = p.query_id AND n.id = p.event_id)) WHERE n <= 50 AND score >= 0.4),
found AS (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM recalled UNION ALL SELECT * FROM new_event) GROUP BY ALL),
best AS (SELECT query_id, id, score, n AS r1, count(*) OVER (PARTITION BY query_id) AS total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM found) WHERE n <= 100),
body AS (SELECT event_id AS id, 'title' AS field, title AS text FROM ev UNION ALL SELECT event_id, 'content', content FROM ev),
question AS (SELECT query_id, text FROM q), {BM25_SQL},
words AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS r2 FROM
  (SELECT f.query_id, f.id, max(f.s * CASE f.field WHEN 'title' THEN 2 ELSE 1 END) AS s FROM by_field f JOIN best b ON b.query_id = f.query_id AND b.id = f.id GROUP BY ALL)),
fused AS (SELECT b.query_id, b.id, 1 / (60 + b.r1) + 1 / (60 + coalesce(w.r2, b.total + 1)) AS score FROM best b LEFT JOIN words w USING (query_id, id)),
final AS (SELECT query_id, id, score, place FROM ({_RANKED.format("SELECT * FROM fused")}) WHERE place <= 10)"""


def _graph_search(spark: SparkSession, sf_dir: str):
    events, queries, seeds, edges, vectors = _setting(spark, sf_dir)
    index = bm25.Index(events, "event_id", ["title", "content"])
    relations = graph.relations_of(edges, title_vectors(spark, sf_dir, events))
    ranked, routes = retrieval.graph_search(queries, seeds, edges, vectors, GraphConfig(), index, {"title": 2.0, "content": 1.0}, relations, **EVENT_TYPES)
    return events, ranked, routes


@query(f"WITH {EVENTS_SQL}, {TITLES_SQL}, {_GRAPH_SQL} SELECT query_id, id, round(score, 6) AS score, place FROM final")
def q6_graph_search(spark, sf_dir):
    """Recall on two paths, expansion, rank fusion."""
    return _graph_search(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


@query(f"""WITH {EVENTS_SQL}, {TITLES_SQL}, {_GRAPH_SQL},
chunk AS (SELECT article_id, arg_min(c, {{'r': chunk_rank, 'i': chunk_id}}) AS c FROM (SELECT article_id, chunk_rank, chunk_id, c FROM chunk_draft c) WHERE article_id IS NOT NULL GROUP BY article_id),
hit AS (SELECT f.query_id, f.place AS at_place, f.id AS event_id, c.chunk_id AS chunk_id, coalesce(c.heading, '') AS heading, coalesce(c.content, '') AS content
  FROM final f JOIN ev ON ev.event_id = f.id JOIN chunk ON chunk.article_id = ev.source_id),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY at_place, event_id) AS n FROM hit) WHERE n = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY at_place, event_id) AS place, event_id, chunk_id, heading, content FROM once""")
def q6_graph_sections(spark, sf_dir):
    """The ranked events' chunks, each once."""
    events, ranked, _ = _graph_search(spark, sf_dir)
    return retrieval.hydrate(ranked, events, table(spark, sf_dir, "chunk_draft"), 10)


_ROUTES_SQL = f"""
route AS (SELECT query_id, query_id AS from_node, id AS to_node, 'query' AS from_kind, 'event' AS to_kind, 'event_vector' AS method, 0 AS hop, score FROM path_a
  UNION ALL SELECT query_id, query_id, CAST(entity_id AS VARCHAR), 'query', 'entity', 'entity_match', 0, 1.0 FROM seed
  UNION ALL SELECT b.query_id, CAST(b.entity_id AS VARCHAR), b.event_id, 'entity', 'event', 'entity_to_event', 0, p.score FROM pair_b b JOIN path_b p ON p.query_id = b.query_id AND p.id = b.event_id
  UNION ALL SELECT query_id, event_id, CAST(entity_id AS VARCHAR), 'event', 'entity', 'event_to_entity', 1, 1.0 FROM related
  UNION ALL SELECT x.query_id, CAST(x.entity_id AS VARCHAR), x.event_id, 'entity', 'event', 'expand_to_event', 1, n.score FROM pair_x x JOIN new_event n ON n.query_id = x.query_id AND n.id = x.event_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, from_node, to_node, method) AS position FROM
  (SELECT query_id, from_node, to_node, from_kind, to_kind, method, hop, max(score) AS score FROM route GROUP BY ALL)),
behind AS (SELECT query_id, id AS node FROM final UNION SELECT p.query_id, p.from_node FROM behind b JOIN placed p ON p.query_id = b.query_id AND p.to_node = b.node)"""
_ROUTE_ROWS_SQL = "SELECT DISTINCT p.* REPLACE (round(p.score, 6) AS score) FROM placed p JOIN behind b ON b.query_id = p.query_id AND b.node = p.to_node"


@query(f"""WITH RECURSIVE {EVENTS_SQL}, {TITLES_SQL}, {_GRAPH_SQL}, {_ROUTES_SQL} {_ROUTE_ROWS_SQL}""")
def g6_routes(spark, sf_dir):
    """The routes by which the answers were reached."""
    _, ranked, routes = _graph_search(spark, sf_dir)
    answers = ranked.select("query_id", F.col("id").alias("node"))
    return graph.trace_back(answers, routes, depth=5).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, {TITLES_SQL}, {_GRAPH_SQL}, {_ROUTES_SQL}, kept AS ({_ROUTE_ROWS_SQL}),
step AS (SELECT query_id, from_node, to_node, method AS stage, max({{'s': score, 'h': -hop}}) AS b FROM kept GROUP BY ALL)
SELECT query_id, from_node, to_node, stage, 'final' AS level, b.s AS score, -b.h AS hop FROM step""")
def g8_clues(spark, sf_dir):
    """Each step of the answers' routes once."""
    return graph.clues(g6_routes(spark, sf_dir))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, {TITLES_SQL}, {_GRAPH_SQL}, {_ROUTES_SQL}, kept AS ({_ROUTE_ROWS_SQL}),
node AS (SELECT query_id, from_node AS node, from_kind AS kind FROM kept UNION SELECT query_id, to_node, to_kind FROM kept),
name AS (SELECT CAST(entity_id AS VARCHAR) AS node, 'entity' AS kind, arg_max(name, updated_time) AS name FROM sag2_entity GROUP BY entity_id UNION ALL SELECT event_id, 'event', title FROM ev)
SELECT query_id, node, kind, name FROM node LEFT JOIN name USING (node, kind)""")
def g8_clue_nodes(spark, sf_dir):
    """The nodes of the answers' routes, each once, with their names."""
    events, _, routes = _graph_search(spark, sf_dir)
    entities = filters.latest(table(spark, sf_dir, "sag2_entity").select("entity_id", "name", "updated_time"), "entity_id", "updated_time")
    named = entities.select(F.col("entity_id").cast("string").alias("node"), F.lit("entity").alias("kind"), "name").unionByName(events.select(F.col("event_id").alias("node"), F.lit("event").alias("kind"), F.col("title").alias("name")))
    return graph.clue_nodes(g6_routes(spark, sf_dir), named)


@query(f"""WITH RECURSIVE {EVENTS_SQL},
node AS (SELECT 'event_id' AS kind, event_id AS node, count(*) AS degree FROM edge GROUP BY event_id UNION ALL SELECT 'entity_id', CAST(entity_id AS VARCHAR), count(*) FROM edge GROUP BY entity_id)
SELECT kind, count(*) AS n_nodes, CAST(sum(degree) AS BIGINT) AS n_edges, max(degree) AS max_degree, round(avg(degree), 6) AS mean_degree FROM node GROUP BY kind""")
def a28_degrees(spark, sf_dir):
    """Degrees of both sides of the graph."""
    _, _, _, edges, _ = _setting(spark, sf_dir)
    return graph.node_degrees(edges).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("degree").alias("n_edges"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("mean_degree")
    )


@query(f"""WITH RECURSIVE {EVENTS_SQL}, link AS (SELECT 'v' || event_id AS u, 'n' || entity_id AS v FROM edge), both_ways AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT u AS root, u AS node FROM both_ways UNION SELECT r.root, b.v FROM reach r JOIN both_ways b ON b.u = r.node),
size AS (SELECT component, count(*) AS size FROM (SELECT node, min(root) AS component FROM reach GROUP BY node) GROUP BY component), degree AS (SELECT u AS node, count(*) AS d FROM both_ways GROUP BY u)
SELECT n_nodes, n_events, n_entities, n_edges, mean_degree, max_degree, degree_over_1, degree_over_2, degree_over_3, n_components, giant_size, mean_size, median_size, geometric_size, harmonic_size, round(2 * n_edges / (n_nodes * (n_nodes - 1)), 9) AS density FROM
 (SELECT count(*) AS n_nodes, count(*) FILTER (node[1] = 'v') AS n_events, count(*) FILTER (node[1] = 'n') AS n_entities, CAST(sum(d) / 2 AS BIGINT) AS n_edges, round(avg(d), 6) AS mean_degree, max(d) AS max_degree,
   count(*) FILTER (d > 1) AS degree_over_1, count(*) FILTER (d > 2) AS degree_over_2, count(*) FILTER (d > 3) AS degree_over_3 FROM degree),
 (SELECT count(*) AS n_components, max(size) AS giant_size, round(avg(size), 6) AS mean_size, median(size) AS median_size, round(exp(avg(ln(size))), 6) AS geometric_size, round(count(*) / sum(1 / size), 6) AS harmonic_size FROM size)""")
def a27_graph_metrics(spark, sf_dir):
    """Components and sizes of the graph."""
    _, _, _, edges, _ = _setting(spark, sf_dir)
    named = edges.select(F.concat(F.lit("v"), "event_id").alias("src"), F.concat(F.lit("n"), F.col("entity_id").cast("string")).alias("dst"))
    return graph.bipartite_metrics(edges, connected_components(named))


@query(f"""WITH {EVENTS_SQL}, link AS (SELECT DISTINCT least(a.entity_id, b.entity_id) AS src, greatest(a.entity_id, b.entity_id) AS dst FROM edge a JOIN edge b USING (event_id) WHERE a.entity_id <> b.entity_id),
tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM link x JOIN link y ON y.src = x.dst JOIN link z ON z.src = x.src AND z.dst = y.dst)
SELECT node, count(*) AS triangles FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY node""")
def a27_triangles(spark, sf_dir):
    """Triangles of the entities that share an event; events name few entities."""
    _, _, _, edges, _ = _setting(spark, sf_dir)
    link = edges.select("event_id", F.col("entity_id").alias("src")).join(edges.select("event_id", F.col("entity_id").alias("dst")), "event_id").where("src < dst").select("src", "dst").distinct()
    return graph.triangles(link)
