"""Corpora, samples, search results, graphs and documents from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "title string, text string, idx bigint"
SAMPLES = (
    "id string, question string, answer array<string>, answerable boolean, question_type string, "
    "paragraphs array<struct<title:string,text:string,is_supporting:boolean,idx:bigint>>"
)
RESULTS = "question_index bigint, question string, retrieved_docs array<string>, sections array<string>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of passages; ``docs`` is title and text in one."""
    return with_docs(spark.read.schema(CORPUS).json(path, multiLine=True))


def with_docs(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("doc", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).json(path, multiLine=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved search results; older files call the passages sections."""
    rows = spark.read.schema(RESULTS).json(path, multiLine=True)
    return rows.select("question_index", "question", F.coalesce("retrieved_docs", "sections").alias("retrieved_docs"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text) of each markdown file; other files are passed over."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,markdown}", recursiveFileLookup=True)
    title = F.regexp_extract("value", r"(?m)^#{1,6}\s+(.+)$", 1)
    return files.select(F.col("_metadata.file_path").alias("path"), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Untitled")).alias("title"), F.col("value").alias("text"))


def read_graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a GraphML file."""
    schema = "_source string, _target string"
    return spark.read.format("xml").option("rowTag", "edge").schema(schema).load(path).select(F.col("_source").alias("src"), F.col("_target").alias("dst"))


def read_graph_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph kept as two Parquet tables."""
    edges = spark.read.parquet(f"{path}/relationships.parquet").select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight")
    return spark.read.parquet(f"{path}/entities.parquet"), edges


def unified_predictions(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Predictions with ids and gold answers: joined by the trimmed question text.

    ``questions`` has id, question and golds, ``retrieved`` question, answer and contexts. A
    prediction whose question is unknown keeps a null id; repeated questions take the smallest.
    """
    asked = questions.groupBy(F.trim("question").alias("_q")).agg(F.min(F.struct("id", "golds")).alias("_s"))
    joined = retrieved.withColumn("_q", F.trim("question")).join(asked, "_q", "left")
    return joined.select(F.col("_s.id").alias("id"), "question", "answer", "contexts", F.col("_s.golds").alias("golds"))


# fixed values: where each form of saved predictions keeps its columns
PREDICTIONS = {
    "query": "query string, context string, pred_answer string",
    "results": "results array<struct<question:string,docs:array<string>,answer:string,gold_answers:array<string>>>",
}


def read_predictions(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(question, context, answer, golds) of saved predictions.

    ``form`` is query (a JSON array of queries, contexts and answers) or results (an object
    with a list of results, whose documents become one context). Missing texts are empty,
    missing golds an empty list.
    """
    empty, none = F.lit(""), F.array().cast("array<string>")
    rows = spark.read.schema(PREDICTIONS[form]).json(path, multiLine=True)
    if form == "query":
        return rows.select(F.col("query").alias("question"), F.coalesce("context", empty).alias("context"), F.coalesce("pred_answer", empty).alias("answer"), none.alias("golds"))
    each = rows.select(F.explode("results").alias("r")).select("r.*")
    return each.select("question", F.array_join(F.coalesce("docs", none), "\n\n").alias("context"), F.coalesce("answer", empty).alias("answer"), F.coalesce("gold_answers", none).alias("golds"))


def _children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what a folder of any file system holds, the last name first; empty if it is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place) or not system.getFileStatus(place).isDirectory():
        return []
    return sorted(((s.getPath().getName(), s.isDirectory()) for s in system.listStatus(place)), reverse=True)


def _has_results(spark: SparkSession, path: str) -> bool:
    found = _children(spark, path)
    folders = {n for n, is_folder in found if is_folder}
    files = {n for n, is_folder in found if not is_folder}
    named = any((n.startswith("results_") and n.endswith(".json")) or (n.startswith("hybrid_") and n.endswith("_result.json")) for n in files)
    return named or "search_results_full.json" in files or bool(folders & {"response", "qa_result", "evaluation"}) or any(("qa_result", True) in _children(spark, f"{path}/{n}") for n in folders)


def latest_run(spark: SparkSession, root: str, dataset: str, skipped: str = "LlmJudge_") -> str | None:
    """The newest folder of a dataset under ``root`` that holds results, by name; None without one.

    Runs are folders in <root>/<dataset>, or that folder itself, or else <root>/<dataset>_<stamp>.
    """
    stamped = [n for n, is_folder in _children(spark, root) if is_folder and n.startswith(f"{dataset}_") and not n.startswith(skipped)]
    own = dataset if (dataset, True) in _children(spark, root) else None
    first = own or (stamped[0] if stamped else None)
    if first is None:
        return None
    inside = [f"{root}/{first}/{n}" for n, is_folder in _children(spark, f"{root}/{first}") if is_folder and not n.startswith(skipped)]
    options = [*inside, f"{root}/{first}", *(f"{root}/{n}" for n in stamped[:1])]
    return next((p for p in options if _has_results(spark, p)), None)
