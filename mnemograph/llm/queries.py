"""Queries of the numbered problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.llm import leakage, mixing, names, near_duplicates, neighbours, pair_defects, pieces, subjects
from mnemograph.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


# problem 6


@_query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_samples"))


@_query
def p6_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_samples"))


_P6_WINDOWS = r"""
passage AS (
  SELECT id AS sample_id, question AS text FROM eval_samples
  UNION ALL SELECT id, p.text FROM (SELECT id, unnest(paragraphs) AS p FROM eval_samples)
),
passage_words AS (SELECT sample_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM passage WHERE text IS NOT NULL),
phrase AS (
  SELECT DISTINCT sample_id, array_to_string(w[i:i + 11], ' ') AS g
  FROM (SELECT sample_id, w, unnest(range(1, len(w) - 10)) AS i FROM passage_words WHERE len(w) >= 12)
),
document_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
document_window AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 11], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM document_words WHERE len(w) >= 12)
)"""

SQL["p6_found"] = f"WITH {_P6_WINDOWS} SELECT DISTINCT doc_id, sample_id FROM document_window JOIN phrase USING (g)"
SQL["p6_removal_spans"] = f"""
WITH {_P6_WINDOWS},
hit AS (SELECT DISTINCT doc_id, pos, sample_id FROM document_window JOIN phrase USING (g)),
marked AS (
  SELECT *, CASE WHEN pos > max(pos + 12) OVER (PARTITION BY doc_id ORDER BY pos, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    OR row_number() OVER (PARTITION BY doc_id ORDER BY pos, sample_id) = 1 THEN 1 ELSE 0 END AS is_new FROM hit
),
span AS (SELECT *, sum(is_new) OVER (PARTITION BY doc_id ORDER BY pos, sample_id ROWS UNBOUNDED PRECEDING) AS k FROM marked)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) - min(pos) + 12 AS INTEGER) AS n_words,
  list_sort(list(DISTINCT sample_id)) AS sample_ids
FROM span GROUP BY doc_id, k
"""


# problem 5


@_query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_tables(spark, sf_dir).where("piece = 0").select("table_name", "item_id")


@_query
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_tables(spark, sf_dir)


SQL["p5_found"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, {item_id} AS item_id
    FROM {name}, (SELECT min(max_tokens) AS most FROM size_limits WHERE table_name = '{name}' AND field_name = '{field}')
    WHERE floor((8 * (length({field}) - length(regexp_replace({field}, '[一-鿿]', '', 'g')))
      + 3 * length(regexp_replace({field}, '[一-鿿]', '', 'g'))) / 12) > most"""
    for name, item_id, field in pieces.ITEMS
)


# problem 4


def _sample_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "sample_corpus"), "idx", ["title", "text"], width=3, threshold=0.6)


@_query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.all_pairs(_sample_groups(spark, sf_dir).select("id", "group_id"), "idx")


@_query
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample_groups(spark, sf_dir).withColumnRenamed("id", "idx")


_P4_GROUPS = r"""
words AS (SELECT idx, regexp_extract_all(lower(concat(coalesce(title, ''), ' ', coalesce(text, ''))), '[\p{L}\p{N}]+') AS w FROM sample_corpus),
run AS (SELECT DISTINCT idx, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT idx, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
sizes AS (SELECT idx, count(*) AS n FROM run GROUP BY idx),
shared AS (SELECT a.idx AS a, b.idx AS b, count(*) AS o FROM run a JOIN run b USING (g) WHERE a.idx < b.idx GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN sizes x ON x.idx = a JOIN sizes y ON y.idx = b WHERE o / (x.n + y.n - o) >= 0.6),
edge AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT u AS root, u AS v FROM edge UNION SELECT r.root, e.v FROM reach r JOIN edge e ON e.u = r.v),
member AS (SELECT v AS idx, min(root) AS group_id FROM reach GROUP BY v)"""

SQL["p4_found"] = f"WITH RECURSIVE {_P4_GROUPS} SELECT a.idx AS idx_a, b.idx AS idx_b FROM member a JOIN member b USING (group_id) WHERE a.idx < b.idx"


# problem 7


@_query
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@_query
def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mixing.mixed_texts(mixing.mix(documents, table(spark, sf_dir, "mix_targets"))[0], documents)


@_query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


# problem 2

VECTOR_FIELDS = ("content_vector", "title_vector")


@_query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "event_vectors"), VECTOR_FIELDS, k=5, min_score=0.9)


@_query
def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "event_vectors")
    near = [neighbours.similar_events(events, field, k=5) for field in VECTOR_FIELDS]
    return near[0].unionByName(near[1])


_P2_NEAR = " UNION ALL ".join(
    f"""SELECT '{field}' AS vector_field, a.event_id, b.event_id AS other_id,
      (1 + list_cosine_similarity(a.v, b.v)) / 2 AS score,
      row_number() OVER (PARTITION BY a.event_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.event_id) AS place
    FROM (SELECT event_id, v FROM latest WHERE field = '{field}') a, (SELECT event_id, v FROM latest WHERE field = '{field}') b
    WHERE a.event_id <> b.event_id"""
    for field in VECTOR_FIELDS
)
_P2_LATEST = " UNION ALL ".join(
    f"""SELECT '{field}' AS field, event_id, CAST(v AS DOUBLE[]) AS v
    FROM (SELECT event_id, arg_max({field}, created_time) AS v, arg_max(is_delete, created_time) AS gone FROM event_vectors GROUP BY event_id)
    WHERE NOT gone AND len(v) = 128 AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"""
    for field in VECTOR_FIELDS
)
SQL["p2_found"] = f"""
WITH latest AS ({_P2_LATEST}), near AS ({_P2_NEAR})
SELECT DISTINCT vector_field, least(event_id, other_id) AS event_id_a, greatest(event_id, other_id) AS event_id_b
FROM near WHERE place <= 5 AND score >= 0.9
"""


# problem 1


@_query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = names.linked_names(table(spark, sf_dir, "sag2_entity"))
    return near_duplicates.all_pairs(linked.select(F.col("entity_id").alias("id"), "group_id"), "entity_id")


@_query
def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_names(table(spark, sf_dir, "sag2_entity"))


# problem 3


def _sample_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in ("generation_samples", "retrieval_samples")}


@_query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.defective_pairs(_sample_tables(spark, sf_dir))


@_query
def p3_clause_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.tagged_defects(_sample_tables(spark, sf_dir))


# problem 8


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")))


@_query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


@_query
def p8_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_leaves(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")))


@_query
def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(_subjects(spark, sf_dir), table(spark, sf_dir, "subject_areas"))
