"""Evaluation metrics as columns over lists, and their averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_recall(retrieved: Column, gold: Column, k: int) -> Column:
    """Distinct gold items among the first k, of all distinct gold items; 0 without gold."""
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), gold))
    n = F.size(F.array_distinct(gold))
    return F.when(n > 0, found / n).otherwise(0.0)


def list_precision(retrieved: Column, gold: Column, k: int) -> Column:
    """Distinct hits of what was returned, at most k, by how much was returned."""
    top = F.slice(retrieved, 1, k)
    return F.when(F.size(top) > 0, F.size(F.array_intersect(top, gold)) / F.size(top)).otherwise(0.0)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def hits(retrieved: Column, gold: Column, k: int) -> Column:
    """Hits among the first k, repeated ones counted each."""
    return F.size(F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(gold, x)))


def strict_precision(retrieved: Column, gold: Column, k: int) -> Column:
    return hits(retrieved, gold, k) / F.lit(float(k))


def counted_recall(retrieved: Column, gold: Column, k: int) -> Column:
    """Hits of all distinct gold items; repeated hits count each, so it may exceed 1."""
    n = F.size(F.array_distinct(gold))
    return F.when(n > 0, hits(retrieved, gold, k) / n).otherwise(0.0)


def ndcg(retrieved: Column, gold: Column, k: int) -> Column:
    """Discounted gain of the first k by the best that the distinct gold items could give."""
    gains = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(gold, x), 1 / F.log2(i + 2.0)).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.size(F.array_distinct(gold))))), lambda i: 1 / F.log2(i + 1.0))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(gold) > 0, total(gains) / total(ideal)).otherwise(0.0)


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(places) > 0, 1 / F.element_at(places, 1)).otherwise(0.0)


def hit_class(retrieved: Column, gold: Column, k: int) -> Column:
    """zero, partial or full, by how many gold items were found; without gold zero."""
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), gold))
    return F.when(found == 0, "zero").when(found < F.size(F.array_distinct(gold)), "partial").otherwise("full")


def long_form(rows: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """(keys, metric, value): one row for each metric."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()))).alias("m")
    return rows.select(*keys, pairs).select(*keys, "m.metric", "m.value")


def averages(long: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """The mean of each metric without NaN; NaN where nothing is left."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return long.groupBy(*(by or []), "metric").agg(F.round(F.coalesce(F.avg(value), F.lit(float("nan"))), digits).alias("mean"), F.count(value).alias("n"))


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two word lists as multisets."""
    words = F.array_distinct(predicted)
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    same = F.aggregate(F.transform(words, lambda w: F.least(count(predicted, w), count(gold, w))), F.lit(0), lambda a, x: a + x)
    p, r = same / F.size(predicted), same / F.size(gold)
    return F.when((F.size(predicted) == 0) | (F.size(gold) == 0), (F.size(predicted) == F.size(gold)).cast("double")).when(same == 0, 0.0).otherwise(2 * p * r / (p + r))


def answer_scores(answers: DataFrame, golds: DataFrame) -> DataFrame:
    """(id, em, f1): exact match and token F1 of each answer (id, answer), the best over its golds (id, gold).

    Texts are cut to words once; words with their counts meet by an equality join, so the
    work grows with the words, not with their square. Null golds count as empty, repeated
    golds once; an answer without golds is left out.
    """
    from mnemograph.functions.text import answer_tokens

    empty = F.array().cast("array<string>")
    p = answers.select("id", F.coalesce(answer_tokens(F.col("answer")), empty).alias("p"))
    g = golds.select("id", F.coalesce(answer_tokens(F.col("gold")), empty).alias("g")).distinct().withColumn("gold_no", F.xxhash64("g"))
    count = lambda rows, keys, words, n: rows.select(*keys, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias(n))
    met = count(g, ["id", "gold_no"], "g", "n_g").join(count(p, ["id"], "p", "n_p"), ["id", "word"])
    same = met.groupBy("id", "gold_no").agg(F.sum(F.least("n_g", "n_p")).alias("same"))
    pairs = g.join(p, "id").select("id", "gold_no", (F.col("p") == F.col("g")).cast("int").alias("em"), F.size("p").alias("n_p"), F.size("g").alias("n_g"))
    both = pairs.join(same, ["id", "gold_no"], "left").withColumn("same", F.coalesce("same", F.lit(0)))
    precision, recall = F.try_divide("same", "n_p"), F.try_divide("same", "n_g")
    value = F.when((F.col("n_p") == 0) | (F.col("n_g") == 0), (F.col("n_p") == F.col("n_g")).cast("double")).when(F.col("same") == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return both.groupBy("id").agg(F.max("em").alias("em"), F.max(value).alias("f1"))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    small = 1e-10
    p, r = tp / (tp + fp + small), tp / (tp + fn + small)
    return (1 + beta**2) * p * r / (beta**2 * p + r + small)


def merged_results(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Old rows patched by new ones: a value of the new run wins where it is not null."""
    a = old.select(key, *(F.col(v).alias(f"_o_{v}") for v in values))
    b = new.select(key, *(F.col(v).alias(f"_n_{v}") for v in values))
    return a.join(b, key, "full").select(key, *(F.coalesce(f"_n_{v}", f"_o_{v}").alias(v) for v in values))


def ids_to_rerun(samples: DataFrame, results: DataFrame, key: str, value: str) -> DataFrame:
    """Samples without a result, or whose result is NaN."""
    done = results.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key)
    return samples.select(key).join(done, key, "left_anti")


def additive_totals(rows: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Seconds and counts of each stage, and of all stages in a row without a stage."""
    return rows.rollup(stage).agg(F.sum(seconds).alias("seconds"), F.count(F.lit(1)).alias("n"))


def evidence_sentences(facts: DataFrame, context: DataFrame) -> DataFrame:
    """(id, at, sentence): sentences that facts (id, at, title, sentence_index) name in context (id, title, sentences).

    A fact without such a title, or with an index outside its sentences, gives none; of a
    title that comes twice the last counts (by ``at``).
    """
    last = context.groupBy("id", "title").agg(F.max_by("sentences", "at").alias("sentences"))
    found = facts.join(last, ["id", "title"]).withColumn("sentence", F.get("sentences", F.col("sentence_index")))
    return found.where((F.col("sentence_index") >= 0) & F.col("sentence").isNotNull()).select("id", "at", "sentence")


def evidence_coverage(stages: DataFrame, texts: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, stage, n_candidates, hit, total, coverage, hit_ids): how much of the gold each stage still holds.

    ``stages`` has query_id, stage and id; ``texts`` id and text; ``gold`` query_id and
    text. Texts are compared in their normal form and count once; queries without gold are
    left out.
    """
    from mnemograph.functions.text import evidence_text

    wanted = gold.select("query_id", evidence_text(F.col("text")).alias("text")).where("text != ''").distinct()
    total = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    seen = stages.select("query_id", "stage", "id").distinct()
    said = seen.join(texts.select("id", evidence_text(F.col("text")).alias("text")), "id")
    hits = said.join(wanted, ["query_id", "text"]).groupBy("query_id", "stage").agg(F.countDistinct("text").alias("hit"), F.array_sort(F.collect_set("id")).alias("hit_ids"))
    sizes = seen.groupBy("query_id", "stage").agg(F.count(F.lit(1)).alias("n_candidates"))
    joined = sizes.join(total, "query_id").join(hits, ["query_id", "stage"], "left")
    hit = F.coalesce("hit", F.lit(0))
    return joined.select("query_id", "stage", "n_candidates", hit.alias("hit"), "total", F.round(hit / F.col("total"), 4).alias("coverage"), F.coalesce("hit_ids", F.array()).alias("hit_ids"))


def mean_of_graphs(rows: DataFrame, graph: str) -> DataFrame:
    """(metric, mean, n_graphs): each number of a row for each graph, averaged over the graphs."""
    names = [c for c in rows.columns if c != graph]
    return averages(long_form(rows, [graph], {c: F.col(c) for c in names})).withColumnRenamed("n", "n_graphs")
