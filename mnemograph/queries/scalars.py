"""Queries over text and date scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph.functions import dates, text
from mnemograph.queries.registry import query
from mnemograph.session import table

NOW = "2025-06-01 00:00:00"


@query(r"""
SELECT doc_id, md5(text) AS text_md5,
  CASE WHEN length(text) <= 80 THEN text ELSE text[1:77] || '...' END AS truncated,
  length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) AS n_cjk,
  CAST(floor((8 * (length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) + 3 * length(regexp_replace(text, '[一-鿿]', '', 'g'))) / 12) AS BIGINT) AS n_tokens,
  len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '\s', '', 'g') <> '')) AS n_paragraphs,
  len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS n_sentences,
  substr(sha256(concat_ws('|', coalesce(title, ''), text)), 1, 16) AS cache_key
FROM documents
""")
def x_text_scalars(spark, sf_dir):
    """X5, X6, X8, X9, X10, X14, X35 over whole documents."""
    d = table(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select(
        "doc_id", F.md5(t).alias("text_md5"), text.truncate(t, 80).alias("truncated"), text.cjk_count(t).alias("n_cjk"), text.estimate_tokens(t).alias("n_tokens"),
        F.size(text.paragraphs(t)).alias("n_paragraphs"), F.size(text.split_sentences(t)).alias("n_sentences"),
        text.cache_key(F.coalesce("title", F.lit("")), t).alias("cache_key"),
    )


@query(r"""
WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL),
head AS (SELECT doc_id, i, trim(regexp_replace(trim(x), '^#{1,6}\s+', '')) AS h FROM line WHERE regexp_matches(trim(x), '^#{1,6}\s+.+'))
SELECT doc_id, list(h ORDER BY i) AS headings, arg_min(h, i) AS title, count(*) AS n_headings FROM head GROUP BY doc_id
""")
def x_headings(spark, sf_dir):
    """Headings of each document and its title."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.headings(F.col("text")).alias("headings"))
    return d.where(F.size("headings") > 0).select("doc_id", "headings", text.heading_text(F.element_at("headings", 1)).alias("title"), F.size("headings").cast("bigint").alias("n_headings"))


@query(r"""
SELECT id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(answer), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')), ' '),
  lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS normalized FROM generation_samples WHERE answer IS NOT NULL
""")
def x_normalize_answer(spark, sf_dir):
    """X13 over every answer."""
    g = table(spark, sf_dir, "generation_samples").where("answer is not null")
    return g.select("id", text.normalize_answer(F.col("answer")).alias("normalized"))


@query(r"""
SELECT id, array_to_string(list_transform(contexts[1:3], lambda p: 'Wikipedia Title: ' || p || chr(10) || chr(10)), '') || 'Question: ' || question || chr(10) || 'Thought: ' AS prompt
FROM retrieval_samples WHERE question IS NOT NULL AND contexts IS NOT NULL
""")
def x_qa_prompt(spark, sf_dir):
    """The prompt of each retrieval sample."""
    r = table(spark, sf_dir, "retrieval_samples").where("question is not null and contexts is not null")
    return r.select("id", text.qa_prompt(F.col("contexts"), F.col("question"), 3).alias("prompt"))


@query(r"""
SELECT chunk_id, trim(CASE WHEN trim(regexp_replace(string_split(content, chr(10))[1], '^#+', '')) = trim(heading)
    THEN concat_ws(chr(10), coalesce(heading, ''), regexp_replace(content, '^[^\n]*\n?', ''))
    ELSE concat_ws(chr(10), coalesce(heading, ''), content) END, ' ') AS section,
  coalesce(heading, '') || chr(10) || chr(10) || substr(content, 1, 1024) AS embedding_input
FROM chunk_draft WHERE content IS NOT NULL
""")
def x_sections(spark, sf_dir):
    """Section texts and what is embedded of a chunk."""
    c = table(spark, sf_dir, "chunk_draft").where("content is not null")
    h, b = F.col("heading"), F.col("content")
    return c.select("chunk_id", text.section_text(h, b).alias("section"), text.embedding_input(h, b, 1024).alias("embedding_input"))


def _truths_sql(table_name: str) -> str:
    return f"""SELECT id, CASE WHEN ground_truth IS NULL THEN [] WHEN ground_truth LIKE '[%' THEN CAST(from_json(ground_truth, '["VARCHAR"]') AS VARCHAR[])
      WHEN ground_truth LIKE '"%' THEN CAST(from_json('[' || ground_truth || ']', '["VARCHAR"]') AS VARCHAR[]) ELSE [ground_truth] END AS golds FROM {table_name}"""


@query(f"SELECT id, golds, CASE WHEN len(list_filter(golds, lambda g: trim(g) <> '')) > 0 THEN list_filter(golds, lambda g: trim(g) <> '')[1] END AS canonical FROM ({_truths_sql('generation_samples')})")
def x_ground_truths(spark, sf_dir):
    """The answers of a polymorphic field and the first filled one."""
    g = table(spark, sf_dir, "generation_samples").select("id", text.ground_truths(F.col("ground_truth")).alias("golds"))
    return g.select("id", "golds", text.first_filled(F.col("golds")).alias("canonical"))


@query(f"""
SELECT event_id, created_time, round(exp(-0.01 * greatest(0, floor(epoch(TIMESTAMP '{NOW}' - start_time) / 86400))), 6) AS decay,
  start_time + INTERVAL 8 HOUR AS local_start, strftime(start_time, '%Y-%m-%d %H:%M') AS shown
FROM event_vectors WHERE start_time IS NOT NULL
""")
def d_event_times(spark, sf_dir):
    """Decay, local time and format of event times."""
    e = table(spark, sf_dir, "event_vectors").where("start_time is not null")
    now = F.lit(NOW).cast("timestamp_ntz")
    s = F.col("start_time")
    return e.select("event_id", "created_time", F.round(dates.time_decay(s, now), 6).alias("decay"), dates.beijing(s).alias("local_start"), F.date_format(s.cast("timestamp"), "yyyy-MM-dd HH:mm").alias("shown"))


@query(f"""
SELECT event_id, created_time, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || ' minutes ago'
  WHEN s < 86400 THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || ' hours ago' WHEN s < 2592000 THEN CAST(CAST(floor(s / 86400) AS BIGINT) AS VARCHAR) || ' days ago'
  WHEN s < 31536000 THEN CAST(CAST(floor(s / 2592000) AS BIGINT) AS VARCHAR) || ' months ago' ELSE CAST(CAST(floor(s / 31536000) AS BIGINT) AS VARCHAR) || ' years ago' END AS age
FROM (SELECT event_id, created_time, epoch(TIMESTAMP '{NOW}') - floor(epoch(created_time)) AS s FROM event_vectors WHERE created_time IS NOT NULL)
""")
def d_time_ago(spark, sf_dir):
    """D3: how old each event is."""
    e = table(spark, sf_dir, "event_vectors").where("created_time is not null")
    return e.select("event_id", "created_time", dates.time_ago(F.col("created_time"), F.lit(NOW).cast("timestamp_ntz")).alias("age"))


@query()
def x_embedding_text(spark, sf_dir):
    """Normal forms that SQL engines treat differently (tested against Python)."""
    d = table(spark, sf_dir, "sag2_entity").where("name is not null")
    n = F.col("name")
    return d.select("entity_id", text.squeeze(n).alias("squeezed"), text.normalize_for_embedding(n).alias("normal"), text.entity_key(n).alias("key"), text.text_id(n).alias("node_id"))
