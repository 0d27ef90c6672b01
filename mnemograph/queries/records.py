"""Queries of sinks, filters, replies, typed values and evaluation records.

What a run of models would leave behind (replies, marks, a second run) is derived from the
given tables by fixed rules, which the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph.functions import dates, replies, text, values
from mnemograph.operators import chunking, extraction, filters, knn, metrics, ranking
from mnemograph.queries.evaluation import _lists
from mnemograph.queries.registry import query
from mnemograph.queries.retrieval import EVENT_TYPES, EVENTS_SQL, FLAT_SQL, _setting
from mnemograph.queries.scalars import _truths_sql
from mnemograph.session import cut, table
from mnemograph.sources import sinks

# sinks


@query("""WITH new AS (SELECT article_id, section_id AS chunk_id, heading FROM section_draft WHERE order_index % 2 = 1)
SELECT article_id, chunk_id, heading FROM chunk_draft WHERE article_id IS NULL OR article_id NOT IN (SELECT article_id FROM new WHERE article_id IS NOT NULL) UNION ALL SELECT * FROM new""")
def s7_replaced_rows(spark, sf_dir):
    """An article's chunks replaced by its odd sections; other articles keep theirs."""
    old = table(spark, sf_dir, "chunk_draft").select("article_id", "chunk_id", "heading")
    new = table(spark, sf_dir, "section_draft").where("order_index % 2 = 1").select("article_id", F.col("section_id").alias("chunk_id"), "heading")
    return sinks.replace_of(old, new, "article_id")


@query("""WITH first AS (SELECT entity_id, min(updated_time) AS t FROM sag2_entity GROUP BY 1),
old AS (SELECT e.entity_id, max({'t': e.updated_time, 'n': e.name}) AS r FROM sag2_entity e JOIN first f ON f.entity_id = e.entity_id AND f.t = e.updated_time GROUP BY 1),
new AS (SELECT e.entity_id, max({'t': e.updated_time, 'n': e.name}) AS r FROM sag2_entity e JOIN first f ON f.entity_id = e.entity_id AND f.t < e.updated_time GROUP BY 1)
SELECT coalesce(o.entity_id, n.entity_id) AS entity_id, coalesce(n.r, o.r).t AS updated_time, coalesce(n.r, o.r).n AS name, n.r IS NOT NULL AS is_new FROM old o FULL JOIN new n ON o.entity_id = n.entity_id""")
def s8_upserted_entities(spark, sf_dir):
    """Later deliveries upserted over the first ones."""
    e = table(spark, sf_dir, "sag2_entity").select("entity_id", "updated_time", "name")
    first = e.groupBy("entity_id").agg(F.min("updated_time").alias("t"))
    both = e.join(first, "entity_id")
    old = both.where("updated_time = t").groupBy("entity_id").agg(F.max(F.struct("updated_time", "name")).alias("r")).select("entity_id", "r.*")
    new = both.where("updated_time > t").select("entity_id", "updated_time", "name")
    return sinks.upsert(old.withColumn("is_new", F.lit(False)), new.withColumn("is_new", F.lit(True)), "entity_id")


@query("""WITH again AS (SELECT event_id, source_id, title FROM event_vectors WHERE category = 'research' OR category IS NULL),
kept AS (SELECT event_id, source_id, title, coalesce(is_delete, false) OR coalesce(source_id IN (SELECT source_id FROM again WHERE source_id IS NOT NULL), false) AS is_delete FROM event_vectors)
SELECT *, 'old' AS run FROM kept UNION ALL SELECT event_id, source_id, title, false, 'new' FROM again""")
def e16_soft_deleted(spark, sf_dir):
    """The events of articles that are extracted again are marked, the new ones added."""
    e = table(spark, sf_dir, "event_vectors")
    old = e.select("event_id", "source_id", "title", "is_delete", F.lit("old").alias("run"))
    new = e.where("category = 'research' or category is null").select("event_id", "source_id", "title", F.lit(False).alias("is_delete"), F.lit("new").alias("run"))
    return sinks.soft_delete_then_insert(old, new, "source_id")


# filters


@query("""SELECT chunk_id, article_id, source_config_id FROM chunk_draft WHERE source_config_id IN (SELECT source_config_id FROM chunk_draft GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
  AND article_id IN (SELECT article_id FROM section_draft WHERE order_index >= 1)""")
def f4_allowed_chunks(spark, sf_dir):
    """chunks of the three largest sources whose article has a second section."""
    c = table(spark, sf_dir, "chunk_draft").select("chunk_id", "article_id", "source_config_id")
    largest = [r[0] for r in c.groupBy("source_config_id").count().orderBy(F.desc("count"), "source_config_id").limit(3).collect()]
    articles = table(spark, sf_dir, "section_draft").where("order_index >= 1")
    return filters.allowed(c.where(filters.in_sources(F.col("source_config_id"), largest)), articles, "article_id")


@query(f"""WITH {EVENTS_SQL} SELECT event_id, CAST('0x' || event_id[1:7] AS BIGINT) AS pos FROM event WHERE event_id IN (SELECT event_id FROM ev)""")
def f12_active_events(spark, sf_dir):
    """of all events in a given order (by a number in their id) those that are live, with their positions."""
    wanted = table(spark, sf_dir, "event_vectors").select("event_id", F.conv(F.substring("event_id", 1, 7), 16, 10).cast("bigint").alias("pos")).distinct()
    events, *_ = _setting(spark, sf_dir)
    return filters.in_given_order(wanted, events, "event_id")


@query("""WITH asked AS (SELECT DISTINCT name FROM sag2_entity WHERE entity_type = 'person' AND source_config_id IN (SELECT source_config_id FROM sag2_entity GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AND name IS NOT NULL)
SELECT entity_id, updated_time, name, entity_type FROM (SELECT e.*, row_number() OVER (PARTITION BY name ORDER BY entity_id, updated_time) AS n FROM sag2_entity e WHERE name IN (SELECT name FROM asked) AND entity_type = 'person') WHERE n <= 3""")
def f13_exact_names(spark, sf_dir):
    """persons of any source named exactly like one of the largest source, at most three of each name."""
    e = table(spark, sf_dir, "sag2_entity").where("entity_type = 'person'").select("entity_id", "updated_time", "name", "entity_type", "source_config_id")
    largest = table(spark, sf_dir, "sag2_entity").groupBy("source_config_id").count().orderBy(F.desc("count"), "source_config_id").limit(1)
    asked = e.join(largest, "source_config_id", "left_semi").where("name is not null")
    return filters.exact_names(e.drop("source_config_id"), "name", asked, 3, [F.col("entity_id"), F.col("updated_time")])


@query("""SELECT id, name, weight, score, is_finite FROM (SELECT entity_id AS id, updated_time, name, weight, coalesce(CASE WHEN weight <> 0 THEN weight END, length(description), 0) AS score,
  coalesce(isfinite(weight), false) AS is_finite FROM sag2_entity) WHERE id BETWEEN 100 AND 20000""")
def f24_scored_entities(spark, sf_dir):
    """the first score that is not zero, which scores are numbers, and a range of ids."""
    e = table(spark, sf_dir, "sag2_entity").withColumnRenamed("entity_id", "id")
    ranged = filters.question_range(e, "id", 100, 20000)
    score = filters.truthy_score(F.col("weight"), F.length("description").cast("double"))
    return ranged.select("id", "name", "weight", score.alias("score"), filters.finite(F.col("weight").cast("string")).alias("is_finite"))


@query(f"""WITH {EVENTS_SQL}, near AS (SELECT q.query_id, ev.event_id AS id, {FLAT_SQL.format(a="q.vec", b="ev.vec")} AS score FROM q, ev),
pair AS (SELECT DISTINCT s.query_id, e.event_id AS id FROM seed s JOIN edge e USING (entity_id))
SELECT query_id, id, round(score, 6) AS score FROM pair JOIN near USING (query_id, id)""")
def j12_cached_scores(spark, sf_dir):
    """Entity hits take the score of the vector path where it has one, the others are scored."""
    _, queries, seeds, edges, vectors = _setting(spark, sf_dir)
    known = knn.exact_knn(queries, vectors.select("id", "vec"), 50, **EVENT_TYPES)
    pairs = seeds.join(edges, "entity_id").select("query_id", F.col("event_id").alias("id"))
    return knn.score_missing(pairs, known, queries, vectors).withColumn("score", F.round("score", 6))


# evaluation records


@query("""WITH m AS (SELECT id, len(list_intersect(coalesce(contexts, []), coalesce(evidences, []))) AS tp, len(list_distinct(coalesce(contexts, []))) AS n, len(list_distinct(coalesce(evidences, []))) AS g FROM retrieval_samples),
r AS (SELECT id, tp / (tp + (n - tp) + 1e-10) AS p, tp / (tp + (g - tp) + 1e-10) AS r FROM m)
SELECT id, round(5 * p * r / (4 * p + r + 1e-10), 6) AS f2, round(2 * p * r / (p + r + 1e-10), 6) AS f1 FROM r""")
def a17_f_beta(spark, sf_dir):
    """F1 and F2 of the retrieved contexts."""
    l = _lists(spark, sf_dir).select("id", F.array_distinct("got").alias("got"), F.array_distinct("gold").alias("gold"))
    tp = F.size(F.array_intersect("got", "gold"))
    parts = (tp, F.size("got") - tp, F.size("gold") - tp)
    return l.select("id", F.round(metrics.f_beta(*parts, 2.0), 6).alias("f2"), F.round(metrics.f_beta(*parts), 6).alias("f1"))


def _two_runs(spark, sf_dir):
    """Scores of a run over all samples, some not a number, and of a second run over a part of them."""
    g = table(spark, sf_dir, "generation_samples").select("id", F.length("answer").cast("double").alias("n"))
    old = g.select("id", F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 11 != 0, F.col("n")).alias("score"), F.lit("first").alias("run"))
    new = g.where("id % 7 = 0").select("id", (F.col("n") + 1).alias("score"), F.when(F.col("id") % 2 == 0, "second").alias("run"))
    return g, old, new


@query("""SELECT id, CASE WHEN id % 7 = 0 THEN coalesce(length(answer) + 1, 'nan'::DOUBLE) WHEN id % 11 <> 0 THEN length(answer) END AS score, CASE WHEN id % 7 = 0 AND id % 2 = 0 THEN 'second' ELSE 'first' END AS run FROM generation_samples""")
def a34_merged_results(spark, sf_dir):
    """A first run patched by a second one."""
    _, old, new = _two_runs(spark, sf_dir)
    return metrics.merged_results(old, new, "id", ["score", "run"])


@query("SELECT id FROM generation_samples WHERE id % 7 = 0 OR id % 11 = 0 OR answer IS NULL")
def a35_ids_to_rerun(spark, sf_dir):
    """Samples whose first run gave nothing or no number."""
    g, old, _ = _two_runs(spark, sf_dir)
    return metrics.ids_to_rerun(g, old, "id", "score")


@query(r"""WITH said AS (SELECT id, 'first' AS stage, unnest(contexts) AS t FROM retrieval_samples UNION ALL SELECT id, 'second', unnest(contexts[1:2]) FROM retrieval_samples),
gold AS (SELECT DISTINCT id, lower(trim(regexp_replace(trim(t), '\s+', ' ', 'g'))) AS t FROM (SELECT id, unnest(evidences) AS t FROM retrieval_samples) WHERE trim(t) <> ''),
sized AS (SELECT id, stage, count(DISTINCT t) AS n FROM said WHERE t IS NOT NULL GROUP BY ALL), total AS (SELECT id, count(*) AS total FROM gold GROUP BY 1),
hit AS (SELECT s.id, s.stage, count(DISTINCT g.t) AS hit FROM said s JOIN gold g ON g.id = s.id AND g.t = lower(trim(regexp_replace(trim(s.t), '\s+', ' ', 'g'))) GROUP BY ALL)
SELECT z.id AS query_id, z.stage, z.n AS n_candidates, coalesce(h.hit, 0) AS hit, t.total, round(coalesce(h.hit, 0) / t.total, 4) AS coverage FROM sized z JOIN total t USING (id) LEFT JOIN hit h ON h.id = z.id AND h.stage = z.stage""")
def a21_evidence_coverage(spark, sf_dir):
    """How much evidence all contexts, and the first two, still hold."""
    r = table(spark, sf_dir, "retrieval_samples")
    listed = r.select(F.col("id").alias("query_id"), "contexts", F.slice("contexts", 1, 2).alias("few"))
    stages = [listed.select("query_id", F.lit(s).alias("stage"), F.explode(c).alias("id")).where("id is not null") for s, c in (("first", "contexts"), ("second", "few"))]
    both = stages[0].unionByName(stages[1])
    texts = both.select("id", F.col("id").alias("text")).distinct()
    gold = r.select(F.col("id").alias("query_id"), F.explode("evidences").alias("text"))
    return metrics.evidence_coverage(both, texts, gold).drop("hit_ids")


@query("""WITH f AS (SELECT id, p.idx AS at, p.title AS title, CAST(p.idx % 3 AS INTEGER) AS k FROM (SELECT id, unnest(paragraphs) AS p FROM eval_samples) WHERE p.is_supporting),
c AS (SELECT id, p.title AS title, arg_max(string_split(p.text, '. '), p.idx) AS s FROM (SELECT id, unnest(paragraphs) AS p FROM eval_samples) WHERE p.text IS NOT NULL GROUP BY ALL)
SELECT f.id, f.at, c.s[f.k + 1] AS sentence FROM f JOIN c USING (id, title) WHERE c.s[f.k + 1] IS NOT NULL""")
def j18_evidence_sentences(spark, sf_dir):
    """The sentences that facts name by title and number, with numbers out of range."""
    p = table(spark, sf_dir, "eval_samples").select("id", F.explode("paragraphs").alias("p")).select("id", F.col("p.idx").alias("at"), "p.title", "p.text", "p.is_supporting")
    context = p.where("text is not null").select("id", "at", "title", F.split("text", r"\. ").alias("sentences"))
    facts = p.where("is_supporting").select("id", "at", "title", (F.col("at") % 3).cast("int").alias("sentence_index"))
    return metrics.evidence_sentences(facts, context)


@query("""WITH m AS (SELECT source_config_id, count(*) AS n_chunks, avg(length(content)) AS mean_chars FROM chunk_draft GROUP BY 1)
SELECT 'n_chunks' AS metric, round(avg(n_chunks), 4) AS mean, count(n_chunks) AS n_graphs FROM m UNION ALL SELECT 'mean_chars', round(avg(mean_chars), 4), count(mean_chars) FROM m""")
def a29_mean_of_graphs(spark, sf_dir):
    """Numbers of each source's part, averaged over the sources."""
    per = table(spark, sf_dir, "chunk_draft").groupBy("source_config_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.length("content")).alias("mean_chars"))
    return metrics.mean_of_graphs(per, "source_config_id")


# replies

@query("""WITH s AS (SELECT id, CAST(id // 6 % 4 AS VARCHAR) AS r FROM generation_samples),
v AS (SELECT id, CASE WHEN id % 6 = 5 THEN NULL WHEN CAST(r AS INTEGER) <= 2 THEN CAST(r AS DOUBLE) WHEN id % 6 = 1 THEN 2 END AS rating FROM s)
SELECT id, rating, CASE WHEN rating IS NULL THEN 0.5 ELSE round((rating / 2 + 0.5) / 2, 6) END AS mean FROM v""")
def x28_ratings(spark, sf_dir):
    """Ratings out of replies in several shapes, and their mean with a second one of 1."""
    r = F.floor(F.col("id") / 6) % 4
    r, kind = r.cast("string"), F.col("id") % 6
    said = (
        F.when(kind == 0, F.concat(F.lit('{"rating": '), r, F.lit("}"))).when(kind == 1, F.concat(F.lit("I would say "), r, F.lit(" of 2"))).when(kind == 2, F.concat(F.lit("["), r, F.lit("]")))
        .when(kind == 3, r).when(kind == 4, F.concat(F.lit('```json {"score": '), r, F.lit("} ```"))).otherwise("none")
    )
    g = table(spark, sf_dir, "generation_samples").select("id", replies.rating_of(said).alias("rating"))
    return g.select("id", "rating", F.round(replies.mean_rating(F.col("rating"), F.lit(1.0)), 6).alias("mean"))


@query("""WITH g AS (SELECT id, list_filter(list_transform(evidences, lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, '"') AND NOT contains(x, '[') AND NOT contains(x, ']') AND NOT contains(x, ',') AND NOT contains(x, chr(92)) AND NOT contains(x, chr(10))) AS e FROM retrieval_samples WHERE evidences IS NOT NULL)
SELECT id, CASE WHEN id % 4 = 3 THEN [] ELSE e END AS items, CASE WHEN len(e) > 0 THEN round(len(list_filter(e, lambda x: length(x) % 2 = 0)) / len(e), 6) END AS even_share FROM g""")
def x26_parsed_lists(spark, sf_dir):
    """Lists out of replies: JSON, fenced JSON, a bare list with words around it, and none."""
    odd = F.lit(r'["\[\],\\\n]')
    r = table(spark, sf_dir, "retrieval_samples").where("evidences is not null")
    e = F.filter(F.transform("evidences", lambda x: F.trim(x)), lambda x: (x != "") & ~F.regexp_like(x, odd))
    r = r.select("id", e.alias("e"))
    json = F.to_json(F.struct(F.col("e").alias("items")))
    quoted = F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))
    kind = F.col("id") % 4
    said = F.when(kind == 0, json).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), json, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("The items are "), quoted, F.lit(" as asked."))).otherwise("I found nothing")
    marks = F.transform("e", lambda x: (F.length(x) % 2 == 0).cast("double"))
    share = replies.attributed_ratio(marks)
    return r.select("id", replies.parse_list(said, "items").alias("items"), F.when(~F.isnan(share), F.round(share, 6)).alias("even_share"))


@query(r"""SELECT id, CASE WHEN contexts IS NULL OR trim(w) = '' THEN [] WHEN id % 3 = 0 THEN ['-----' || chr(10) || w] ELSE list_filter(list_transform(string_split(w, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:2] END AS kept
FROM (SELECT id, contexts, array_to_string(list_filter(contexts, lambda x: x <> ''), chr(10) || chr(10)) AS w FROM retrieval_samples)""")
def x22_contexts(spark, sf_dir):
    """Contexts cut to two paragraphs; every third is a graph context and stays whole."""
    r = table(spark, sf_dir, "retrieval_samples")
    full = F.filter("contexts", lambda x: x != "")
    marked = F.when((F.col("id") % 3 == 0) & (F.size(full) > 0), F.transform("contexts", lambda x, i: F.when((i == 0), F.concat(F.lit("-----\n"), x)).otherwise(x))).otherwise(F.col("contexts"))
    return r.select("id", replies.preprocess_context(marked, 2).alias("kept"))


@query("""WITH e AS (SELECT event_id, source_id, title, row_number() OVER (PARTITION BY source_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY source_id) AS n, coalesce(is_delete, false) AS gone
  FROM (SELECT event_id, arg_max(source_id, created_time) AS source_id, arg_max(title, created_time) AS title, arg_max(is_delete, created_time) AS is_delete FROM event_vectors GROUP BY 1) WHERE source_id IS NOT NULL AND title IS NOT NULL),
root AS (SELECT source_id, gone AS root_gone FROM e WHERE k = 0)
SELECT source_id, CASE WHEN k = 0 THEN '0' ELSE '0.' || (k - 1) END AS path, CASE WHEN k > 0 THEN '0' END AS parent, CASE WHEN k = 0 THEN 0 ELSE 1 END AS level, title, event_id AS content FROM e JOIN root USING (source_id) WHERE NOT root_gone AND NOT gone""")
def e1_flattened_items(spark, sf_dir):
    """A reply for each article, its first event with the others below it, back to flat items."""
    from pyspark.sql import Window

    e = filters.latest(table(spark, sf_dir, "event_vectors").select("event_id", "created_time", "source_id", "title", "is_delete"), "event_id", "created_time").where("source_id is not null and title is not null")
    own = Window.partitionBy("source_id").orderBy("event_id")  # an article has few events
    item = F.struct("title", F.col("event_id").alias("content"), (~F.coalesce("is_delete", F.lit(False))).alias("is_valid"))
    ranked = e.select("source_id", F.row_number().over(own).alias("k"), item.alias("item"))
    below = ranked.where("k > 1").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("children"))
    root = ranked.where("k = 1").join(below, "source_id", "left").select("source_id", F.to_json(F.struct(F.struct(F.array(F.struct("item.*", "children")).alias("items")).alias("data"))).alias("reply"))
    return extraction.flatten_events(root, "source_id", "reply").select("source_id", "path", "parent", "level", "title", "content")


@query("""SELECT chunk_id, list_transform(CASE WHEN len(list_filter(refs, lambda r: r BETWEEN 1 AND len(section_order_indices))) > 0 THEN list_filter(refs, lambda r: r BETWEEN 1 AND len(section_order_indices)) ELSE range(1, len(section_order_indices) + 1) END,
  lambda r: section_order_indices[r]) AS sections FROM (SELECT chunk_id, section_order_indices, [1, 99, CAST(chunk_rank AS BIGINT) + 1] AS refs FROM chunk_draft WHERE len(section_order_indices) > 0 AND chunk_rank > 0)
UNION ALL SELECT chunk_id, section_order_indices FROM chunk_draft WHERE len(section_order_indices) > 0 AND chunk_rank = 0""")
def e2_resolved_references(spark, sf_dir):
    """Numbers of a reply to the sections of its chunk; without a usable one, all of them."""
    c = table(spark, sf_dir, "chunk_draft").where(F.size("section_order_indices") > 0)
    refs = F.when(F.col("chunk_rank") > 0, F.array(F.lit("1"), F.lit("99"), (F.col("chunk_rank") + 1).cast("string"))).otherwise(F.array(F.lit("x"), F.lit("0")))
    return c.select("chunk_id", extraction.resolve_references(refs, F.col("section_order_indices")).alias("sections"))


@query("""WITH e AS (SELECT entity_id, updated_time, entity_type, name, description FROM sag2_entity WHERE name IS NOT NULL)
SELECT entity_id, updated_time, list_sort(list_concat(CASE WHEN entity_id % 5 = 0 THEN ['forbidden note'] ELSE [] END, CASE WHEN trim(name) = '' THEN ['no title'] ELSE [] END,
  CASE WHEN entity_id % 4 = 1 THEN ['a valid item without entities'] WHEN trim(coalesce(description, '')) = '' THEN ['entity 0: no description'] ELSE [] END)) AS errors FROM e""")
def x29_contract_errors(spark, sf_dir):
    """Compact replies made of entities, with what violates their contract."""
    e = table(spark, sf_dir, "sag2_entity").where("name is not null")
    entity = F.struct(F.col("entity_type").alias("type"), "name", "description")
    entities = F.when(F.col("entity_id") % 4 == 1, F.array().cast("array<struct<type:string,name:string,description:string>>")).otherwise(F.array(entity))
    note = F.when(F.col("entity_id") % 5 == 0, "x")
    item = F.struct(F.col("name").alias("title"), F.lit("text").alias("content"), F.lit(True).alias("is_valid"), entities.alias("entities"), note.alias("note"))
    made = e.select(F.struct("entity_id", "updated_time").alias("k"), F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("data"))).alias("reply"))
    return replies.contract_errors(made, "k", "reply").select("k.*", F.array_sort("errors").alias("errors"))


@query("""WITH i AS (SELECT source_config_id AS source, name, description, entity_type FROM sag2_entity WHERE source_config_id IS NOT NULL)
SELECT source, count(*) AS n_items, count(*) AS no_references, count(*) FILTER (trim(coalesce(name, '')) = '') AS no_title, count(*) FILTER (trim(coalesce(description, '')) = '') AS no_content,
  list_sort(coalesce(list(DISTINCT entity_type) FILTER (entity_type IS NOT NULL AND entity_type NOT IN ('', 'person', 'organization')), [])) AS unknown_types FROM i GROUP BY 1""")
def x30_quality_counts(spark, sf_dir):
    """Faults of extracted items that do not stop a run, by source."""
    e = table(spark, sf_dir, "sag2_entity").where("source_config_id is not null")
    entity = F.struct(F.col("entity_type").alias("type"), "name", "description")
    items = e.select(F.col("source_config_id").alias("source"), F.col("name").alias("title"), F.col("description").alias("content"), F.lit(None).cast("array<string>").alias("references"), F.array(entity).alias("entities"))
    return replies.quality_counts(items, "source", ["person", "organization"])


@query("""WITH mean AS (SELECT entity_type AS type, round(avg(weight), 3) AS weight FROM sag2_entity WHERE entity_type IN ('person', 'organization', 'time') GROUP BY 1),
types AS (SELECT 'person' AS type, 0.6 AS threshold, weight FROM mean WHERE type = 'person' UNION ALL SELECT 'organization', 0.9, weight FROM mean WHERE type = 'organization')
SELECT e.entity_id, e.updated_time, e.entity_type AS type, coalesce(t.threshold, 0.8) AS threshold, coalesce(t.weight, 1.0) AS weight FROM sag2_entity e LEFT JOIN types t ON t.type = e.entity_type WHERE e.weight >= coalesce(t.threshold, 0.8)""")
def j14_type_thresholds(spark, sf_dir):
    """Types of two tables, the first one preferred, as thresholds for scored entities."""
    e = table(spark, sf_dir, "sag2_entity")
    mean = e.where("entity_type in ('person', 'organization')").groupBy(F.col("entity_type").alias("type")).agg(F.round(F.avg("weight"), 3).alias("weight"))
    own = mean.where("type = 'person'").select("type", F.lit(0.6).alias("threshold"), "weight")
    general = mean.select("type", F.lit(0.9).alias("threshold"), "weight")
    hits = e.select("entity_id", "updated_time", F.col("entity_type").alias("type"), F.col("weight").alias("score"))
    return extraction.over_type_threshold(hits, extraction.resolved_types([own, general])).drop("score")


@query("""SELECT c.chunk_id, c.article_id, a.t AS source_created_time FROM chunk_draft c LEFT JOIN (SELECT article_id, min(created_time) AS t FROM structured_block WHERE article_id IS NOT NULL GROUP BY 1) a ON a.article_id = c.article_id""")
def j22_source_times(spark, sf_dir):
    """Chunks with the time at which their article was made."""
    return extraction.created_of_source(table(spark, sf_dir, "chunk_draft").select("chunk_id", "article_id"), table(spark, sf_dir, "structured_block"))


@query("SELECT chunk_id, coalesce(length(content) >= 20, false) AS worth_extraction FROM chunk_draft")
def f16_long_enough(spark, sf_dir):
    """F16: chunks with enough text to extract from."""
    return table(spark, sf_dir, "chunk_draft").select("chunk_id", chunking.long_enough(F.col("content")).alias("worth_extraction"))


# scalars


@query(r"""SELECT doc_id, CAST(greatest(1, floor((len(regexp_extract_all(text, '[一-鿿]')) * 16 + len(regexp_extract_all(text, '[A-Za-z0-9]')) * 6 + length(regexp_replace(text, '[A-Za-z0-9\s一-鿿]', '', 'g')) * 12) / 24)) AS BIGINT) AS n_tokens,
  trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x)), chr(10)), ' ') AS cleaned,
  coalesce(nullif(array_to_string(list_filter([trim(title), trim(text)], lambda x: x IS NOT NULL AND x <> ''), chr(10)), ''), CAST(doc_id AS VARCHAR)) AS rerank_text
FROM documents WHERE text IS NOT NULL""")
def x11_cleaned_texts(spark, sf_dir):
    """X11, X12, X17 over whole documents."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    t = F.col("text")
    return d.select("doc_id", text.estimate_model_tokens(t).alias("n_tokens"), text.clean_lines(t).alias("cleaned"), text.rerank_text(F.col("title"), t, F.col("doc_id").cast("string")).alias("rerank_text"))


@query(r"""SELECT id, CASE WHEN contains(lower(answer), 'answer:') THEN trim(list_last(string_split(lower(answer), 'answer:'))) ELSE lower(trim(answer)) END AS bare, lower(trim(answer)) AS marked,
  regexp_replace(answer, '^\s+|\s+$', '', 'g') AS unfenced FROM generation_samples WHERE answer IS NOT NULL AND NOT contains(answer, '```')""")
def x20_answers(spark, sf_dir):
    """Answers behind a mark, with and without one, and out of a fenced block."""
    g = table(spark, sf_dir, "generation_samples").where("answer is not null and not contains(answer, '```')")
    a = F.col("answer")
    marked = F.concat(F.lit("Thought: so. ANSWER: no answer:  "), a)
    fenced = F.concat(F.lit("See\n```json\n"), a, F.lit("\n```"))
    return g.select("id", F.lower(text.extract_answer(a)).alias("bare"), F.lower(text.extract_answer(marked)).alias("marked"), text.strip_fence(F.when(values.stripped(a) == "", F.lit("")).otherwise(fenced)).alias("unfenced"))


@query(r"""SELECT id, list_transform(contexts, lambda t: lower(array_to_string(list_transform(string_split(regexp_replace(trim(t), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10)))) AS normal FROM retrieval_samples WHERE contexts IS NOT NULL""")
def x16_evidence_texts(spark, sf_dir):
    """Contexts in the form in which evidence is compared."""
    r = table(spark, sf_dir, "retrieval_samples").where("contexts is not null")
    return r.select("id", F.transform("contexts", text.evidence_text).alias("normal"))


@query("""SELECT event_id, created_time, start_time AS parsed, CAST(NULL AS TIMESTAMP) AS broken, start_time - INTERVAL 2 HOUR AS shifted FROM event_vectors WHERE start_time IS NOT NULL""")
def d1_parsed_times(spark, sf_dir):
    """ISO texts to naive UTC times, with Z and with an offset; what is none is null."""
    e = table(spark, sf_dir, "event_vectors").where("start_time is not null")
    shown = F.date_format(F.col("start_time").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    iso = lambda end: dates.strip_timezone(F.concat(shown, F.lit(end)))
    return e.select("event_id", "created_time", dates.parse_iso(F.concat(shown, F.lit("Z"))).alias("parsed"), dates.parse_iso(F.concat(F.lit("on "), shown)).alias("broken"), iso("+02:00").alias("shifted"))


@query(r"""SELECT entity_id, updated_time, trim(regexp_replace(name, '\s+', ' ', 'g')) AS squeezed, trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}\p{M}_\s]', '', 'g'), '\s+', ' ', 'g')) AS key,
  h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab89ab89ab89ab'[strpos('0123456789abcdef', h[17])] || h[18:20] || '-' || h[21:32] AS node_id
FROM (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(name)) AS h FROM sag2_entity WHERE name IS NOT NULL)""")
def x1_name_forms(spark, sf_dir):
    """Names with single blanks, as keys, and their ids."""
    e = table(spark, sf_dir, "sag2_entity").where("name is not null")
    n = F.col("name")
    return e.select("entity_id", "updated_time", text.squeeze(n).alias("squeezed"), text.entity_key(n).alias("key"), text.text_id(n).alias("node_id"))


# typed values

_MAP_SQL = lambda pairs: "MAP {" + ", ".join(f"'{k}': {v}" for k, v in pairs.items()) + "}"
_VALUES_SQL = r"""
shape AS (SELECT *, regexp_extract(t, '^([0-9,.]+(?:[eE][+-]?[0-9]+)?)\s*[a-zA-Z一-龥]*$', 1) AS raw_number, nullif(regexp_extract(t, '^[0-9,.]+(?:[eE][+-]?[0-9]+)?\s*([a-zA-Z一-龥]*)$', 1), '') AS found_unit,
  regexp_replace(regexp_replace(replace(regexp_replace(t, '[年月]', '-', 'g'), '日', ''), '-+', '-', 'g'), '^-|-$', '', 'g') AS c FROM src),
dates AS (SELECT *,
  regexp_extract(c, '(\d{4})-(\d{1,2})-(\d{1,2})[\sT]+(\d{1,2}):(\d{1,2}):(\d{1,2})', ['y', 'm', 'd', 'h', 'i', 's']) AS a,
  regexp_extract(c, '(\d{4})-(\d{1,2})-(\d{1,2})[\sT]+(\d{1,2}):(\d{1,2})', ['y', 'm', 'd', 'h', 'i']) AS b, regexp_extract(c, '(\d{4})-(\d{1,2})-(\d{1,2})', ['y', 'm', 'd']) AS e,
  regexp_extract(c, '(\d{4})-(\d{1,2})(?:[^\d]|$)', ['y', 'm']) AS f, regexp_extract(c, '^(\d{4})(?:[^\d]|$)', 1) AS g FROM shape),
made AS (SELECT *, try_cast(a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0') || ' ' || lpad(a.h, 2, '0') || ':' || lpad(a.i, 2, '0') || ':' || lpad(a.s, 2, '0') AS TIMESTAMP) AS t6,
  try_cast(b.y || '-' || lpad(b.m, 2, '0') || '-' || lpad(b.d, 2, '0') || ' ' || lpad(b.h, 2, '0') || ':' || lpad(b.i, 2, '0') || ':00' AS TIMESTAMP) AS t5,
  try_cast(e.y || '-' || lpad(e.m, 2, '0') || '-' || lpad(e.d, 2, '0') AS TIMESTAMP) AS t3, try_cast(f.y || '-' || lpad(f.m, 2, '0') || '-01' AS TIMESTAMP) AS t2,
  CASE WHEN try_cast(g AS INTEGER) BETWEEN 1970 AND 2099 AND NOT regexp_matches(lower(t), @MARKS) THEN try_cast(g || '-01-01' AS TIMESTAMP) END AS t1,
  CASE WHEN contains(lower(kind), 'time') THEN CASE WHEN regexp_matches(t, '^\d{14}$') THEN try_strptime(t, '%Y%m%d%H%M%S') WHEN regexp_matches(t, '^\d{12}$') THEN try_strptime(t, '%Y%m%d%H%M')
    WHEN regexp_matches(t, '^\d{8}$') THEN try_strptime(t, '%Y%m%d') WHEN regexp_matches(t, '^\d{6}$') THEN try_strptime(t, '%Y%m') END END AS tc,
  try_cast(replace(raw_number, ',', '') AS DOUBLE) * coalesce(map_extract(@UNITS, found_unit)[1], 1) AS num,
  CASE WHEN length(t) <= 6 AND regexp_matches(t, '^[@NUMERALS]+$') THEN list_reduce(list_prepend([1.0, 0.0], list_transform(list_reverse(string_split(t, '')), lambda x: [CAST(map_extract(@DIGITS, x)[1] AS DOUBLE), 0.0])),
    lambda s, x: CASE WHEN x[1] < 10 THEN [s[1], s[2] + x[1] * s[1]] WHEN x[1] > s[1] THEN [x[1], s[2]] ELSE [s[1] * x[1], s[2]] END)[2] END AS cn,
  CASE WHEN length(t) <= 10 AND lower(t) IN @TRUE THEN true WHEN length(t) <= 10 AND lower(t) IN @FALSE THEN false END AS truth FROM dates),
chosen AS (SELECT *, coalesce(tc, t6, t5, t3, t2, t1) AS day, CASE WHEN tc IS NOT NULL THEN CASE length(t) WHEN 12 THEN 0.92 WHEN 6 THEN 0.9 ELSE 0.95 END WHEN t6 IS NOT NULL THEN 0.98 WHEN t5 IS NOT NULL THEN 0.95 WHEN t3 IS NOT NULL THEN 0.98 WHEN t2 IS NOT NULL THEN 0.9 WHEN t1 IS NOT NULL THEN 0.85 END AS day_sure,
  coalesce(num, nullif(cn, 0)) AS n FROM made)@SPLIT
SELECT kind, name, CASE WHEN t = '' THEN 'text' WHEN day IS NOT NULL THEN 'datetime' WHEN n = floor(n) THEN 'int' WHEN n IS NOT NULL THEN 'float' WHEN truth IS NOT NULL THEN 'bool' ELSE 'text' END AS value_type,
  CASE WHEN t = '' THEN name ELSE t END AS value_raw, CASE WHEN day IS NULL AND n = floor(n) AND abs(n) < 9e18 THEN CAST(n AS BIGINT) END AS int_value, CASE WHEN day IS NULL AND n <> floor(n) THEN n END AS float_value, day AS datetime_value,
  CASE WHEN day IS NULL AND n IS NULL THEN truth END AS bool_value, CAST(NULL AS VARCHAR) AS enum_value, CASE WHEN day IS NULL AND num IS NOT NULL THEN found_unit END AS value_unit,
  CASE WHEN day IS NOT NULL THEN day_sure WHEN num IS NOT NULL THEN 0.95 WHEN n IS NOT NULL THEN 0.85 WHEN truth IS NOT NULL THEN 0.95 ELSE 1.0 END AS value_confidence, 'code' AS origin FROM chosen"""
_VALUES_SQL = (
    _VALUES_SQL.replace("@MARKS", "'" + "|".join(values.AMOUNT_MARKS).lower() + "'").replace("@UNITS", _MAP_SQL({k: float(v) for k, v in values.UNIT_FACTORS.items()})).replace("@NUMERALS", "".join(values.NUMERALS))
    .replace("@DIGITS", _MAP_SQL(values.NUMERALS)).replace("@TRUE", str(values.TRUE_WORDS)).replace("@FALSE", str(values.FALSE_WORDS))
)
_PARSED_SQL, _TYPED_SQL = _VALUES_SQL.split("@SPLIT")
_SPELLED = ("name", "name || ' 12km'", "'3,' || CAST(100 + entity_id % 900 AS VARCHAR) || '.5g'", "'20240' || CAST(100 + entity_id % 900 AS VARCHAR)", "'二百三十五'", "'启用'", "CAST(1900 + entity_id % 250 AS VARCHAR) || '年'", "CAST(entity_id AS VARCHAR) || '万元'")


@query(rf"""WITH spelled AS (SELECT DISTINCT entity_type AS kind, CASE entity_id % 9 {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SPELLED))} ELSE name END AS name FROM sag2_entity WHERE name IS NOT NULL AND entity_type IS NOT NULL),
src AS (SELECT kind, name, regexp_replace(name, '^\s+|\s+$', '', 'g') AS t FROM spelled), {_PARSED_SQL} {_TYPED_SQL}""")
def e6_typed_values(spark, sf_dir):
    """The typed value of every entity name; a part of the names is written as numbers, dates and words of truth."""
    e = table(spark, sf_dir, "sag2_entity").where("name is not null and entity_type is not null")
    written = F.expr(f"CASE entity_id % 9 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_SPELLED)).replace('VARCHAR', 'STRING')} ELSE name END")
    made = e.select(F.col("entity_type").alias("kind"), written.alias("name")).distinct()
    return made.select("kind", "name", values.typed_value(F.col("kind"), F.col("name")).alias("v")).select("kind", "name", "v.*")


@query(r"""WITH e AS (SELECT entity_id, updated_time, name, ['int', 'text', 'datetime', 'number', 'float'][1 + entity_id % 5] AS value_type, CASE WHEN entity_id % 3 > 0 THEN CAST(entity_id % 97 AS VARCHAR) END AS value, CASE WHEN entity_id % 2 = 0 THEN 'kg' END AS unit FROM sag2_entity WHERE name IS NOT NULL)
SELECT entity_id, updated_time, CASE WHEN value IS NULL OR value_type = 'text' THEN name
  WHEN value_type = 'datetime' THEN CASE WHEN regexp_matches(name, '\d{4}年|\d{1,2}月|\d{1,2}日|\d{1,2}[:：点]|\d{4}-') THEN name ELSE name || value END
  WHEN regexp_matches(name, '\d') THEN CASE WHEN unit IS NOT NULL AND NOT contains(name, unit) THEN name || unit ELSE name END
  ELSE CASE WHEN unit IS NOT NULL AND NOT contains(name || value, unit) THEN name || value || unit ELSE name || value END END AS value_raw,
  CASE WHEN value_type <> 'number' AND value IS NOT NULL THEN CAST(value AS BIGINT) END AS model_int FROM e""")
def e7_raw_values(spark, sf_dir):
    """Values that a model gave in parts, as one text and typed."""
    kinds = F.array(*(F.lit(k) for k in ("int", "text", "datetime", "number", "float")))
    i = F.col("entity_id")
    e = table(spark, sf_dir, "sag2_entity").where("name is not null").withColumns(
        {"value_type": F.get(kinds, (i % 5).cast("int")), "value": F.when(i % 3 > 0, (i % 97).cast("string")), "unit": F.when(i % 2 == 0, "kg")}
    )
    typed = values.typed_value(F.lit("other"), F.col("name"), F.col("value_type"), F.col("value"), F.col("unit"))
    raw = values.raw_value(F.col("name"), F.col("value"), F.col("unit"), F.col("value_type"))
    return e.select("entity_id", "updated_time", raw.alias("value_raw"), typed.alias("t")).select("entity_id", "updated_time", "value_raw", F.when(F.col("t.origin") == "model", F.col("t.int_value")).alias("model_int"))


@query("""WITH e AS (SELECT DISTINCT entity_id FROM sag2_entity), t AS (SELECT entity_id, entity_id % 4 AS k, CASE entity_id % 4 WHEN 0 THEN entity_id || '件箱' WHEN 1 THEN '十二箱' WHEN 2 THEN entity_id || '.5箱' ELSE 'none' END AS text FROM e)
SELECT entity_id, CASE k WHEN 0 THEN entity_id WHEN 1 THEN 2 END AS int_value, CASE k WHEN 2 THEN entity_id + 0.5 END AS float_value, CASE WHEN k < 3 THEN '箱' END AS unit, CASE k WHEN 1 THEN 0.9 WHEN 3 THEN NULL ELSE 0.95 END AS confidence,
  CASE WHEN k = 0 THEN 'b' WHEN k = 1 THEN 'UNKNOWN' WHEN k = 2 THEN '.5' ELSE 'None' END AS member FROM t""")
def e10_units_and_members(spark, sf_dir):
    """Numbers before a given unit, in digits and numerals, and members of a list."""
    e = table(spark, sf_dir, "sag2_entity").select("entity_id").distinct()
    i = F.col("entity_id").cast("string")
    k = F.col("entity_id") % 4
    written = F.when(k == 0, F.concat(i, F.lit("件箱"))).when(k == 1, "十二箱").when(k == 2, F.concat(i, F.lit(".5箱"))).otherwise("none")
    v = values.parse_with_unit(written, "箱")
    asked = F.when(k == 0, "b").when(k == 1, "zz").otherwise(written)
    return e.select("entity_id", v["int_value"].alias("int_value"), v["float_value"].alias("float_value"), v["unit"].alias("unit"), v["confidence"].alias("confidence"), values.parse_enum(asked, ["b", ".5", "None"])["enum_value"].alias("member"))


@query(rf"""WITH src AS (SELECT DISTINCT 'time' AS kind, name, regexp_replace(name, '^\s+|\s+$', '', 'g') AS t FROM sag2_entity WHERE entity_type = 'time' AND name IS NOT NULL), {_PARSED_SQL} SELECT name, day AS date_value FROM chosen""")
def e12_time_values(spark, sf_dir):
    """The date that each time entity's name says, null where it says none."""
    e = table(spark, sf_dir, "sag2_entity").where("entity_type = 'time' and name is not null").select("name").distinct()
    return e.select("name", values.parse_value(F.lit("time"), F.col("name"), "datetime").alias("v")).select("name", F.col("v.datetime_value").alias("date_value"))


@query("""WITH e AS (SELECT event_id, arg_max(content_vector, created_time) AS v FROM event_vectors WHERE content_vector IS NOT NULL GROUP BY event_id)
SELECT event_id AS id, list_transform(v[1:64], lambda x: CASE WHEN isfinite(x) THEN round(CAST(x AS DOUBLE), 5) END) AS vec, 4 * least(64, len(v)) AS n_bytes FROM e WHERE CAST('0x' || event_id[1:8] AS BIGINT) % 3 = 0""")
def e19_packed_vectors(spark, sf_dir):
    """Vectors of given events, packed to bytes of 64 numbers and read again."""
    rows = table(spark, sf_dir, "event_vectors").where("content_vector is not null").select("event_id", "created_time", "content_vector")
    vectors = filters.latest(rows, "event_id", "created_time").select(F.col("event_id").alias("id"), F.col("content_vector").alias("vec"))
    asked = vectors.where(F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint") % 3 == 0).select("id")
    packed = knn.vector_of(vectors, asked).select("id", knn.pack_vector(F.col("vec"), 64).alias("b"))
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.round(x.cast("double"), 5))
    return packed.select("id", F.transform(knn.unpack_vector(F.col("b")), finite).alias("vec"), F.length("b").alias("n_bytes"))
