"""Upserts, replacements and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old ones whose key is not among them; of repeated new keys one is kept.

    The kept one is the greatest by all columns, so the result does not depend on the order.
    """
    others = [c for c in new.columns if c != key]
    once = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*others)).alias("_r")).select(key, "_r.*").select(*old.columns)
    return once.unionByName(old.join(once.select(key), key, "left_anti"))


def replace_of(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All rows of the owners in ``new`` are replaced; other owners keep theirs."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def soft_delete_then_insert(old: DataFrame, new: DataFrame, owner: str, flag: str = "is_delete") -> DataFrame:
    """Old rows of the owners in ``new`` are marked deleted, new ones are added."""
    owners = new.select(owner).distinct().withColumn("_again", F.lit(True))
    marked = old.join(owners, owner, "left").withColumn(flag, F.coalesce("_again", F.lit(False)) | F.coalesce(flag, F.lit(False))).drop("_again")
    return marked.unionByName(new)


def change_status(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, status): inserted, updated or unchanged for every new row, kept for the rest."""
    others = [c for c in new.columns if c != key]
    o = old.select(key, F.struct(*others).alias("_o"), F.lit(True).alias("_has_o"))
    n = new.select(key, F.struct(*others).alias("_n"), F.lit(True).alias("_has_n"))
    status = F.when(F.col("_has_n").isNull(), "kept").when(F.col("_has_o").isNull(), "inserted").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("updated")
    return o.join(n, key, "full").select(key, status.alias("status"))


def missing_after(expected: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Keys that should have been written and were not: empty after a sound upsert."""
    return expected.select(key).join(written.select(key), key, "left_anti")


def write_by_source(rows: DataFrame, path: str, source: str = "source_config_id") -> None:
    """Parquet partitioned by source: queries of one source read its folder only."""
    rows.repartition(source, F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(16))).write.mode("overwrite").partitionBy(source).parquet(path)


def write_markdown(corpus: DataFrame, path: str, chunks_per_file: int = 500, parts: int = 64) -> None:
    """Passages as markdown files of at most ``chunks_per_file`` each; what was there is replaced.

    Passages go to a part by their hash and are numbered within it, so no task numbers the
    whole corpus. Each file is one text with its passages in order.
    """
    part = F.pmod(F.xxhash64("title", "text"), F.lit(parts))
    order = Window.partitionBy("part").orderBy("title", "text")
    numbered = corpus.withColumn("part", part).withColumn("file", F.floor((F.row_number().over(order) - 1) / chunks_per_file))
    passage = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n\n"))
    files = numbered.groupBy("part", "file").agg(F.array_join(F.array_sort(F.collect_list(passage)), "").alias("value"))
    files.select("value").write.mode("overwrite").option("lineSep", "\n").text(path)


def log_metrics(metrics: DataFrame, step: int, path: str) -> None:
    """Append (metric, mean) rows of a step to a long-format table."""
    metrics.select(F.lit(step).alias("step"), "metric", F.col("mean").alias("value")).write.mode("append").parquet(path)
