"""Queries of the evaluation metrics and of run statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemograph.functions import text
from mnemograph.functions.rouge import rouge_scores
from mnemograph.operators import metrics
from mnemograph.queries.registry import query
from mnemograph.queries.scalars import _truths_sql
from mnemograph.session import table

KS = (1, 2, 5)


def _lists(spark, sf_dir):
    r = table(spark, sf_dir, "retrieval_samples")
    empty = F.array().cast("array<string>")
    gold = F.coalesce("evidences", empty)
    # every third sample names its first evidence twice: gold is a set
    twice = F.when(F.col("id") % 3 == 0, F.concat(gold, F.slice(gold, 1, 1))).otherwise(gold)
    return r.select("id", "question_type", F.coalesce("contexts", empty).alias("got"), twice.alias("gold"))


def _metrics():
    got, gold = F.col("got"), F.col("gold")
    out = {"mrr": metrics.reciprocal_rank(got, gold)}
    for k in KS:
        p, r = metrics.list_precision(got, gold, k), metrics.distinct_recall(got, gold, k)
        out |= {f"recall@{k}": r, f"precision@{k}": p, f"f1@{k}": metrics.f1(p, r), f"strict_precision@{k}": metrics.strict_precision(got, gold, k), f"counted_recall@{k}": metrics.counted_recall(got, gold, k), f"ndcg@{k}": metrics.ndcg(got, gold, k)}
    return out


_K_SQL = " UNION ALL ".join(
    f"""SELECT id, question_type, 'recall@{k}' AS metric, CASE WHEN len(gold) > 0 THEN found{k} / len(list_distinct(gold)) ELSE 0 END AS value FROM m
    UNION ALL SELECT id, question_type, 'precision@{k}', CASE WHEN n{k} > 0 THEN found{k} / n{k} ELSE 0 END FROM m
    UNION ALL SELECT id, question_type, 'f1@{k}', CASE WHEN found{k} > 0 THEN 2 * (found{k} / n{k}) * (found{k} / len(list_distinct(gold))) / (found{k} / n{k} + found{k} / len(list_distinct(gold))) ELSE 0 END FROM m
    UNION ALL SELECT id, question_type, 'strict_precision@{k}', hits{k} / {k} FROM m
    UNION ALL SELECT id, question_type, 'counted_recall@{k}', CASE WHEN len(gold) > 0 THEN hits{k} / len(list_distinct(gold)) ELSE 0 END FROM m
    UNION ALL SELECT id, question_type, 'ndcg@{k}', CASE WHEN len(gold) > 0 THEN coalesce(list_sum(list_transform(range(1, least(len(got), {k}) + 1), lambda i: CASE WHEN list_contains(gold, got[i]) THEN 1 / log2(i + 1) ELSE 0 END)), 0)
      / list_sum(list_transform(range(1, least({k}, len(list_distinct(gold))) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END FROM m"""
    for k in KS
)
_LISTS_SQL = f"""
l AS (SELECT id, question_type, coalesce(contexts, []) AS got, CASE WHEN id % 3 = 0 THEN coalesce(evidences, []) || coalesce(evidences, [])[1:1] ELSE coalesce(evidences, []) END AS gold FROM retrieval_samples),
m AS (SELECT *, {", ".join(f"len(list_intersect(got[1:{k}], gold)) AS found{k}, least(len(got), {k}) AS n{k}, len(list_filter(got[1:{k}], lambda x: list_contains(gold, x))) AS hits{k}" for k in KS)} FROM l),
long AS (SELECT id, question_type, 'mrr' AS metric, coalesce(1 / list_min(list_filter(list_transform(range(1, len(got) + 1), lambda i: CASE WHEN list_contains(gold, got[i]) THEN i END), lambda i: i IS NOT NULL)), 0) AS value FROM l
  UNION ALL {_K_SQL})"""


@query(f"WITH {_LISTS_SQL} SELECT metric, round(avg(value), 4) AS mean, count(*) AS n FROM long GROUP BY metric")
def q10_retrieval_metrics(spark, sf_dir):
    """Q9, Q10, A4 to A10: every retrieval metric over all samples."""
    return metrics.averages(metrics.long_form(_lists(spark, sf_dir), ["id", "question_type"], _metrics()))


@query(f"WITH {_LISTS_SQL} SELECT coalesce(question_type, 'Uncategorized') AS question_type, metric, round(avg(value), 4) AS mean, count(*) AS n FROM long GROUP BY ALL")
def q11_metrics_by_type(spark, sf_dir):
    """The same by question type."""
    typed = _lists(spark, sf_dir).withColumn("question_type", F.coalesce("question_type", F.lit("Uncategorized")))
    return metrics.averages(metrics.long_form(typed, ["id", "question_type"], _metrics()), ["question_type"])


@query(f"""WITH {_LISTS_SQL} SELECT CASE WHEN found5 = 0 THEN 'zero' WHEN found5 < len(list_distinct(gold)) THEN 'partial' ELSE 'full' END AS class, count(*) AS n,
round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM m GROUP BY 1""")
def a11_hit_classes(spark, sf_dir):
    """Samples with all, some or none of their evidence."""
    counted = _lists(spark, sf_dir).groupBy(metrics.hit_class(F.col("got"), F.col("gold"), 5).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # a row for each class


def _answer_pairs(spark, sf_dir):
    g = table(spark, sf_dir, "generation_samples")
    golds = F.explode(text.ground_truths(F.col("ground_truth"))).alias("gold")
    return g.where("answer is not null").select("id", "question_type", "answer", golds)


_TOKENS = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
_QA_SQL = f"""
pair AS (SELECT g.id, g.question_type, {_TOKENS.format(x="g.answer")} AS p, {_TOKENS.format(x="t.gold")} AS t
  FROM generation_samples g JOIN (SELECT id, unnest(golds) AS gold FROM ({_truths_sql("generation_samples")})) t USING (id) WHERE g.answer IS NOT NULL),
same AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(t, lambda x: x = w))))), 0) AS n FROM pair),
scored AS (SELECT id, any_value(question_type) AS question_type, max(CASE WHEN p = t THEN 1 ELSE 0 END) AS em,
  max(CASE WHEN len(p) = 0 OR len(t) = 0 THEN CASE WHEN len(p) = len(t) THEN 1 ELSE 0 END WHEN n = 0 THEN 0 ELSE 2 * (n / len(p)) * (n / len(t)) / (n / len(p) + n / len(t)) END) AS f1 FROM same GROUP BY id)"""


@query(f"WITH {_QA_SQL} SELECT id, question_type, em, round(f1, 6) AS f1 FROM scored")
def a12_answer_scores(spark, sf_dir):
    """Exact match and token F1 of every answer, the best over its ground truths."""
    g = table(spark, sf_dir, "generation_samples").where("answer is not null")
    golds = g.select("id", F.explode(text.ground_truths(F.col("ground_truth"))).alias("gold"))
    scored = metrics.answer_scores(g.select("id", "answer"), golds)
    return scored.join(g.select("id", "question_type"), "id").select("id", "question_type", "em", F.round("f1", 6).alias("f1"))


@query(f"WITH {_QA_SQL} SELECT coalesce(question_type, 'Uncategorized') AS question_type, round(avg(em), 4) AS em, round(avg(f1), 4) AS f1, count(*) AS n FROM scored GROUP BY 1")
def q8_answers_by_type(spark, sf_dir):
    """Answer scores by question type."""
    scored = a12_answer_scores(spark, sf_dir)
    return scored.groupBy(F.coalesce("question_type", F.lit("Uncategorized")).alias("question_type")).agg(F.round(F.avg("em"), 4).alias("em"), F.round(F.avg("f1"), 4).alias("f1"), F.count(F.lit(1)).alias("n"))


@query()
def a20_rouge(spark, sf_dir):
    """ROUGE-1, -2 and -L of every answer against its ground truths (tested on known cases)."""
    pairs = _answer_pairs(spark, sf_dir).where("gold is not null")
    scored = pairs.select("id", rouge_scores("gold", "answer").alias("r")).select("id", "r.*")
    return scored.groupBy("id").agg(*(F.max(c).alias(c) for c in scored.columns if c != "id"))


@query("SELECT event_type AS stage, sum(value) AS seconds, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def a25_stage_totals(spark, sf_dir):
    """Totals of each stage and of all; the total is the sum of the stages."""
    return metrics.additive_totals(table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), "stage", "value")


@query("""
WITH d AS (SELECT event_type AS stage, CAST(ts AS DATE) AS day, sum(value) AS batch, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT *, sum(batch) OVER (PARTITION BY stage ORDER BY day) AS cumulative FROM d)
SELECT stage, day, n, round(cumulative, 6) AS cumulative, round(cumulative - lag(cumulative, 1, 0) OVER (PARTITION BY stage ORDER BY day), 6) AS delta FROM c
""")
def a24_batch_deltas(spark, sf_dir):
    """Cumulative seconds by stage and day, and their differences."""
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("batch"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("stage").orderBy("day")
    total = daily.withColumn("cumulative", F.sum("batch").over(order))
    delta = F.col("cumulative") - F.lag("cumulative", 1, 0.0).over(order)
    return total.select("stage", "day", "n", F.round("cumulative", 6).alias("cumulative"), F.round(delta, 6).alias("delta"))


@query("""
SELECT dataset, count(*) AS n_passages, count(title) AS n_titled, count(DISTINCT title) AS n_titles, round(avg(length(text)), 4) AS mean_chars FROM sample_corpus GROUP BY dataset
""")
def a30_dataset_stats(spark, sf_dir):
    """Counts of each dataset of the corpus."""
    c = table(spark, sf_dir, "sample_corpus")
    return c.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_passages"), F.count("title").alias("n_titled"), F.countDistinct("title").alias("n_titles"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


@query("""
SELECT id, list(p.title ORDER BY p.idx) AS gold_titles, count(*) AS n_gold FROM (SELECT id, unnest(paragraphs) AS p FROM eval_samples) WHERE p.is_supporting GROUP BY id
""")
def j17_gold_passages(spark, sf_dir):
    """Titles of the supporting passages of each question."""
    p = table(spark, sf_dir, "eval_samples").select("id", F.explode("paragraphs").alias("p")).where("p.is_supporting")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("p.idx", "p.title"))), lambda x: x["title"])
    return p.groupBy("id").agg(titles.alias("gold_titles"), F.count(F.lit(1)).alias("n_gold"))


@query(f"""WITH asked AS (SELECT trim(question) AS k, min(id) AS id FROM retrieval_samples WHERE question IS NOT NULL GROUP BY 1)
SELECT g.id AS sample_id, a.id AS matched_id FROM generation_samples g LEFT JOIN asked a ON a.k = trim(g.question)""")
def s14_match_by_question(spark, sf_dir):
    """Samples joined to another table by the text of their question."""
    asked = table(spark, sf_dir, "retrieval_samples").where("question is not null").groupBy(F.trim("question").alias("k")).agg(F.min("id").alias("matched_id"))
    g = table(spark, sf_dir, "generation_samples").select(F.col("id").alias("sample_id"), F.trim("question").alias("k"))
    return g.join(asked, "k", "left").select("sample_id", "matched_id")
