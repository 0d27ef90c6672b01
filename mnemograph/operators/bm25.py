"""BM25 over an inverted index held as a table of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-cased runs of letters or digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


class Index:
    """Postings (id, field, term, tf, length) with the statistics of each field.

    ``lengths`` is kept apart from the postings. Made from rows, an index is computed anew
    by each search; ``write`` it once and ``read`` it where many searches are made.
    """

    def __init__(self, rows: DataFrame, key: str, fields: list[str]):
        parts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("words")) for f in fields))).alias("p")
        split = rows.select(F.col(key).alias("id"), parts).select("id", "p.field", "p.words").where(F.size("words") > 0)
        self.lengths = split.select("id", "field", F.size("words").alias("length"))
        self.postings = (
            split.select("id", "field", F.size("words").alias("length"), F.explode("words").alias("term"))
            .groupBy("id", "field", "length", "term")
            .agg(F.count(F.lit(1)).alias("tf"))
        )
        #: a row for each field
        self.statistics = self.lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))

    @classmethod
    def of_tables(cls, postings: DataFrame, lengths: DataFrame, statistics: DataFrame) -> Index:
        index = cls.__new__(cls)
        index.postings, index.lengths, index.statistics = postings, lengths, statistics
        return index

    def write(self, path: str, buckets: int = 64) -> None:
        """The index as three Parquet tables; postings are partitioned by a hash of their term."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        self.postings.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.statistics.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")  # a row for each field

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        """A written index; a search reads the partitions of its terms only."""
        return cls.of_tables(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "statistics")))

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """Postings of the given terms (column ``term``)."""
        if "bucket" not in self.postings.columns:
            return self.postings.join(terms.select("term").distinct(), "term", "left_semi")
        first = self.statistics.select("buckets").first()
        if first is None:
            return self.postings.drop("bucket").limit(0)
        known = terms.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(first.buckets)).cast("int"))
        return self.postings.join(known, ["bucket", "term"], "left_semi").drop("bucket")

    def frequencies(self) -> DataFrame:
        return self.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def search(queries: DataFrame, index: Index, boosts: dict[str, float], among: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): the best of a row's boosted field scores, for any query word.

    ``queries`` has query_id and text; blank queries find nothing. ``among`` restricts the
    search to (query_id, id) pairs before scoring.
    """
    asked = queries.where(F.trim("text") != "").select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    known = asked.select("term").distinct()
    postings = index.postings_of(known).where(F.col("field").isin(*boosts))
    df = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    statistics = F.broadcast(index.statistics.where(F.col("field").isin(*boosts)))  # a row for each boosted field
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    weighed = postings.join(df, ["field", "term"]).join(statistics, "field").select("id", "field", "term", (idf * F.col("tf") / norm).alias("weight"))
    hits = asked.join(weighed, "term")
    if among is not None:
        hits = hits.join(among.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    boost = F.coalesce(*(F.when(F.col("field") == f, F.lit(b)) for f, b in boosts.items()), F.lit(0.0))
    by_field = hits.groupBy("query_id", "id", "field").agg(F.sum("weight").alias("weight"))
    return by_field.groupBy("query_id", "id").agg(F.max(F.col("weight") * boost).alias("score"))


def substring_score(queries: DataFrame, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(query_id, id, score): how often the query's words occur in the joined fields, as substrings.

    Words meet the rows that hold their first characters in an equality join, and each
    distinct word is counted once for a row, whatever the number of queries that ask for it.
    A word that a query repeats counts each time; blank queries find nothing.
    """
    from mnemograph.operators.filters import containing

    words = F.filter(F.split(F.trim(F.lower("text")), r"\s+"), lambda w: w != "")
    asked = queries.select("query_id", F.explode(words).alias("word")).groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n"))
    text = F.lower(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields)))
    body = rows.select(F.col(key).alias("id"), text.alias("body"))
    met = containing(body, "id", "body", asked, "word").join(body, "id")
    times = ((F.length("body") - F.length(F.replace(F.col("body"), F.col("needle"), F.lit("")))) / F.length("needle")).cast("bigint")
    counted = met.select("id", F.col("needle").alias("word"), times.alias("times"))
    return asked.join(counted, "word").groupBy("query_id", "id").agg(F.sum(F.col("times") * F.col("n")).alias("score")).where("score > 0")
