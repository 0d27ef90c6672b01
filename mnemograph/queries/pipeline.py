"""Queries of loading, chunking, extraction and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph.operators import chunking, extraction, filters
from mnemograph.queries.registry import query
from mnemograph.session import table
from mnemograph.sources import sinks
from mnemograph.streaming.ingest import windowed_counts


@query(r"""
WITH line AS (SELECT doc_id, i - 1 AS i, string_split(text, chr(10))[i] AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
marked AS (SELECT *, regexp_matches(trim(x), '^#{1,6}\s+.+') AS h FROM line),
numbered AS (SELECT *, CAST(sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS section FROM marked),
grouped AS (SELECT doc_id, section, coalesce(max(CASE WHEN h THEN trim(regexp_replace(trim(x), '^#{1,6}\s+', '')) END), '') AS heading,
  coalesce(trim(string_agg(CASE WHEN NOT h THEN x END, chr(10) ORDER BY i), ' ' || chr(10)), '') AS content FROM numbered GROUP BY doc_id, section)
SELECT * FROM grouped WHERE heading <> '' OR content <> ''
""")
def c6_heading_sections(spark, sf_dir):
    """A section for each heading of every document."""
    return chunking.heading_sections(table(spark, sf_dir, "documents"), "doc_id", "text")


_TOKENS = "CAST(floor((8 * (length({x}) - length(regexp_replace({x}, '[一-鿿]', '', 'g'))) + 3 * length(regexp_replace({x}, '[一-鿿]', '', 'g'))) / 12) AS BIGINT)"


def _chunks_sql(limit: int, strict: bool) -> str:
    """The packing as a fold over units: small sections, and the paragraphs of large ones."""
    fits = f"f.size + r.n <= {limit}"
    heading = " AND r.h = f.first_h" if strict else ""
    same = f"((NOT r.alone AND NOT f.alone AND {fits}{heading}) OR (r.alone AND f.alone AND f.i = r.i AND {fits}))"
    return rf"""
WITH RECURSIVE s AS (SELECT article_id AS doc, order_index AS i, coalesce(heading, '') AS h, regexp_replace(coalesce(content, ''), '^[\s　\x{{A0}}]+|[\s　\x{{A0}}]+$', '', 'g') AS c, coalesce(section_type, 'TEXT') AS kind
  FROM section_draft WHERE article_id IS NOT NULL AND (section_type IS NULL OR section_type <> 'IMAGE')),
sized AS (SELECT *, {_TOKENS.format(x="c")} AS n FROM s),
para AS (SELECT doc, i, h, kind, unnest(string_split(c, chr(10) || chr(10))) AS c, unnest(range(len(string_split(c, chr(10) || chr(10))))) AS p FROM sized WHERE n > 600),
unit AS (SELECT doc, i, 0 AS p, h, kind, c, n, false AS alone FROM sized WHERE n <= 600 UNION ALL SELECT doc, i, p, h, kind, c, {_TOKENS.format(x="c")}, true FROM para),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY i, p) AS k FROM unit),
fold AS (SELECT doc, k, CAST(0 AS BIGINT) AS chunk, n AS size, alone, i, h AS first_h, k AS first_k FROM ranked WHERE k = 1
  UNION ALL SELECT r.doc, r.k, CASE WHEN {same} THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN {same} THEN f.size + r.n ELSE r.n END, r.alone, r.i, CASE WHEN {same} THEN f.first_h ELSE r.h END, CASE WHEN {same} THEN f.first_k ELSE r.k END FROM fold f JOIN ranked r ON r.doc = f.doc AND r.k = f.k + 1),
joined AS (SELECT r.doc, f.chunk, bool_or(r.alone) AS alone, regexp_replace(array_to_string(list(CASE WHEN r.alone AND r.k > f.first_k THEN chr(10) || r.c ELSE r.c END ORDER BY r.k), chr(10)), '^[\s　\x{{A0}}]+|[\s　\x{{A0}}]+$', '', 'g') AS content,
  arg_min(r.h, r.k) FILTER (r.h <> '') AS heading, arg_min(r.kind, r.k) AS section_type, list(r.i ORDER BY r.k) AS spots FROM fold f JOIN ranked r USING (doc, k) GROUP BY r.doc, f.chunk, r.alone)
SELECT doc, CAST(chunk AS INTEGER) AS rank, CAST(CASE WHEN alone THEN 1 ELSE len(spots) END AS INTEGER) AS n_sections, CAST({_TOKENS.format(x="content")} AS INTEGER) AS n_tokens, coalesce(heading, '') AS heading, content, section_type,
  CASE WHEN alone THEN spots[1:1] ELSE spots END AS section_order_indices FROM joined"""


def _sections(spark, sf_dir):
    return table(spark, sf_dir, "section_draft").where("section_type is null or section_type != 'IMAGE'")


@query(_chunks_sql(1000, False))
def c5_assembled_chunks(spark, sf_dir):
    """Sections packed into chunks."""
    return chunking.assemble_chunks(_sections(spark, sf_dir), "article_id", "order_index", "heading", "content", 1000, "section_type")


@query(_chunks_sql(200, True))
def c5_strict_chunks(spark, sf_dir):
    """Small chunks that end where the heading changes."""
    return chunking.assemble_chunks(_sections(spark, sf_dir), "article_id", "order_index", "heading", "content", 200, "section_type", heading_strict=True)


@query(r"""
WITH line AS (SELECT doc_id, i - 1 AS i, string_split(text, chr(10))[i] AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
marked AS (SELECT *, regexp_matches(x, '^#{1,6}\s+.+') AS h FROM line)
SELECT doc_id AS doc, CAST(sum(length(regexp_replace(x, '\s', '', 'g'))) FILTER (NOT h) AS BIGINT) AS n_characters FROM marked GROUP BY doc_id HAVING coalesce(sum(length(regexp_replace(x, '\s', '', 'g'))) FILTER (NOT h), 0) > 0
""")
def c4_section_texts(spark, sf_dir):
    """Sections of every document; together they hold all its text but the headings."""
    s = chunking.block_sections(table(spark, sf_dir, "documents"), "doc_id", "text", 64)
    counted = s.groupBy("doc").agg(F.sum(F.length(F.regexp_replace("content", r"\s", ""))).cast("bigint").alias("n_characters"))
    return counted.select(F.col("doc").cast("bigint").alias("doc"), "n_characters").where("n_characters > 0")


@query()
def c11_loaded_chunks(spark, sf_dir):
    """Every document to sections and chunks with ids and references (tested against a plain fold)."""
    return chunking.load_documents(table(spark, sf_dir, "documents"), "doc_id", "text")[2]


@query("""
SELECT chunk_id, article_id, chunk_rank, lag(heading) OVER (PARTITION BY article_id ORDER BY chunk_rank) AS previous_heading, lag(length(content)) OVER (PARTITION BY article_id ORDER BY chunk_rank) AS previous_length FROM chunk_draft
""")
def j16_previous_chunk(spark, sf_dir):
    """Each chunk with what stands before it."""
    c = table(spark, sf_dir, "chunk_draft").withColumn("length", F.length("content").cast("bigint"))
    return chunking.previous(c, "article_id", "chunk_rank", "heading", "length").select("chunk_id", "article_id", "chunk_rank", "previous_heading", "previous_length")


@query("""
WITH m AS (SELECT source_config_id AS source, entity_type AS kind, lower(trim(name)) AS key, trim(name) AS name, created_time AS t FROM sag2_entity
  WHERE source_config_id IS NOT NULL AND entity_type IS NOT NULL AND length(trim(name)) > 1)
SELECT substr(sha256(concat_ws('|', source, kind, key)), 1, 32) AS id, source, kind, key, arg_min(name, {'t': t, 'n': name}) AS name, count(*) AS mentions FROM m GROUP BY source, kind, key
""")
def e4_distinct_entities(spark, sf_dir):
    """One entity for each source, type and folded name."""
    return extraction.distinct_entities(table(spark, sf_dir, "sag2_entity"), "source_config_id", "entity_type", "name", "created_time")


@query("""
WITH f AS (SELECT entity_type, lower(trim(name)) AS key, description AS d, min({'t': created_time, 'i': entity_id}) AS o FROM sag2_entity WHERE trim(coalesce(description, '')) <> '' AND name IS NOT NULL GROUP BY ALL)
SELECT entity_type, key, string_agg(d, '、' ORDER BY o, d) AS descriptions FROM f GROUP BY ALL
""")
def a33_merged_descriptions(spark, sf_dir):
    """The distinct descriptions of a name in order."""
    e = table(spark, sf_dir, "sag2_entity").where("name is not null").withColumn("key", F.lower(F.trim("name")))
    return extraction.merged_descriptions(e, ["entity_type", "key"], "description", ["created_time", "entity_id"])


@query("""
WITH e AS (SELECT event_id, unnest(entity_ids) AS entity_id FROM event_vectors) SELECT DISTINCT entity_id FROM e WHERE entity_id IS NOT NULL AND entity_id NOT IN (SELECT entity_id FROM sag2_entity WHERE description IS NOT NULL)
""")
def u4_missing_entities(spark, sf_dir):
    """Entity ids that events name and no described entity has."""
    named = table(spark, sf_dir, "event_vectors").select(F.explode("entity_ids").alias("entity_id")).where("entity_id is not null").distinct()
    return sinks.missing_after(named, table(spark, sf_dir, "sag2_entity").where("description is not null"), "entity_id")


@query("""
WITH last AS (SELECT entity_id, max(updated_time) AS t FROM sag2_entity GROUP BY 1), first AS (SELECT entity_id, min(updated_time) AS t FROM sag2_entity GROUP BY 1)
SELECT CASE WHEN f.t = l.t THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n FROM first f JOIN last l USING (entity_id) GROUP BY 1
""")
def s21_change_status(spark, sf_dir):
    """What an upsert of the latest deliveries over the first ones changes."""
    e = table(spark, sf_dir, "sag2_entity")
    first = e.groupBy("entity_id").agg(F.min("updated_time").alias("t"))
    last = e.groupBy("entity_id").agg(F.max("updated_time").alias("t"))
    return sinks.change_status(first, last, "entity_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, arg_max(title, created_time) AS title, max(created_time) AS created_time, count(*) AS deliveries FROM event_vectors GROUP BY event_id
""")
def s8_latest_events(spark, sf_dir):
    """The latest delivery of each event."""
    e = table(spark, sf_dir, "event_vectors").select("event_id", "title", "created_time")
    counts = e.groupBy("event_id").agg(F.count(F.lit(1)).alias("deliveries"))
    return filters.latest(e, "event_id", "created_time").join(counts, "event_id")


@query("""
SELECT title, chunk_id, CAST(row_number() OVER (PARTITION BY article_id ORDER BY chunk_rank, chunk_id) - 1 AS INTEGER) AS position,
  round(chunks_of / greatest(1, sections_of), 2) AS chunks_per_section
FROM (SELECT c.heading AS title, c.chunk_id, c.article_id, c.chunk_rank, count(*) OVER (PARTITION BY c.article_id) AS chunks_of, s.n AS sections_of
  FROM chunk_draft c JOIN (SELECT article_id, count(*) AS n FROM section_draft GROUP BY 1) s USING (article_id))
""")
def r13_chunk_positions(spark, sf_dir):
    """Chunks renumbered within their article, and chunks by section."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "chunk_draft")
    n = table(spark, sf_dir, "section_draft").groupBy("article_id").agg(F.count(F.lit(1)).alias("sections_of"))
    own = Window.partitionBy("article_id")
    place = (F.row_number().over(own.orderBy("chunk_rank", "chunk_id")) - 1).cast("int")
    per = F.round(F.count(F.lit(1)).over(own) / F.greatest(F.lit(1), F.col("sections_of")), 2)
    return c.join(n, "article_id").select(F.col("heading").alias("title"), "chunk_id", place.alias("position"), per.alias("chunks_per_section"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def st_windowed_counts(spark, sf_dir):
    """Beyond the batch operators: tumbling windows, the batch form of the streaming query."""
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))
