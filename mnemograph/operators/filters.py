"""Predicates and projections that the plans share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_sources(column: Column, sources: list[str] | None) -> Column:
    """Membership; no list, or an empty one, restricts nothing."""
    return column.isin(sources) if sources else F.lit(True)


def not_deleted(flag: Column) -> Column:
    """A missing flag or status counts as not deleted."""
    return ~F.coalesce(flag, F.lit(False))


def allowed(rows: DataFrame, ids: DataFrame | None, on: str | list[str]) -> DataFrame:
    """Rows whose key is among ``ids``. None restricts nothing; an empty table leaves nothing."""
    return rows if ids is None else rows.join(ids.select(on).distinct(), on, "left_semi")


def at_least(score: Column, threshold: float) -> Column:
    return score >= threshold


def finite(value: Column) -> Column:
    """A number that is neither NaN nor infinite; what is no number is not."""
    number = value.try_cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))


def finite_vector(vector: Column, dimensions: int | None = None) -> Column:
    fits = F.lit(True) if dimensions is None else F.size(vector) == dimensions
    return F.coalesce(fits & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def truthy_score(first: Column, second: Column) -> Column:
    """The first score that is neither null nor 0, else 0."""
    return F.coalesce(F.nullif(first, F.lit(0.0)), second, F.lit(0.0))


def latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """One row for each key, of its latest time; of equal times the greatest row.

    An aggregate with a map-side part, not a window: a key with very many deliveries
    is never sorted in one task.
    """
    others = [c for c in rows.columns if c != key]
    stamp = F.coalesce(F.col(time).cast("string"), F.lit(""))
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), stamp).alias("_r")).select(key, "_r.*")


def in_given_order(wanted: DataFrame, active: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """The wanted ids that are active, with their positions as they were."""
    return wanted.join(active.select(key).distinct(), key, "left_semi").select(key, position)


def name_tokens(query: Column, most: int = 8) -> Column:
    """The whole query and its words of two or more letters, at most ``most``."""
    low = F.trim(F.lower(query))
    words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= 2)
    return F.slice(F.array_distinct(F.concat(F.array(low), words)), 1, most)


def contains_any(columns: list[Column], tokens: Column) -> Column:
    """Does any of the columns contain any of the tokens, whatever its case."""
    return F.exists(tokens, lambda t: reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), t) for c in columns)))


def question_range(rows: DataFrame, index: str, first: int, last: int) -> DataFrame:
    """Rows whose 0-based index is in the closed range."""
    return rows.where(F.col(index).between(first, last))


def per_key_limit(rows: DataFrame, keys: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first n rows of each key; Spark plans a group limit, which cuts before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(place, F.row_number().over(window)).where(F.col(place) <= n)


def exact_names(rows: DataFrame, name: str, asked: DataFrame, per_name: int, order: list[Column]) -> DataFrame:
    """Rows whose name equals an asked one (column ``name`` of ``asked``), at most ``per_name`` of each."""
    found = rows.join(asked.select(F.col("name").alias(name)).distinct(), name, "left_semi")
    return per_key_limit(found, [name], order, per_name, "_n").drop("_n")


def _grams(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(text, i, F.lit(n)))


def containing(rows: DataFrame, key: str, text: str, needles: DataFrame, needle: str, gram: int = 3) -> DataFrame:
    """(key, needle): which texts contain which needles, whatever their case; an equality join.

    A needle meets the texts that hold its first ``gram`` characters, shorter needles those
    that hold them whole, and what meets is verified. Only distinct runs of a text are
    joined; null and empty needles meet nothing.
    """
    low = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), F.lower(text).alias("_text")).distinct()
    asked = needles.select(F.col(needle).alias("needle")).where(F.coalesce(F.length("needle"), F.lit(0)) > 0).distinct()
    asked = asked.withColumns({"_low": F.lower("needle"), "_gram": F.substring(F.lower("needle"), 1, gram)})
    runs = F.array_distinct(F.flatten(F.array(*(_grams(F.col("_text"), n) for n in range(1, gram + 1)))))
    wanted = low.select(key, F.explode(runs).alias("_gram")).join(asked.select("_gram", "_low", "needle"), "_gram")
    return wanted.join(low, key).where(F.contains("_text", F.col("_low"))).select(key, "needle").distinct()
