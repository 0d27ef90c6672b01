"""What becomes of extracted items: flat events, entities, edges and typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.session import cut

ENTITY = "struct<type:string,name:string,description:string>"
_LEAF = f"title:string,content:string,is_valid:boolean,references:array<string>,entities:array<{ENTITY}>,children:array<string>"
#: levels of children that are followed; a reply that goes deeper raises
DEPTH = 32


def flatten_events(replies: DataFrame, key: str, reply: str, depth: int = DEPTH) -> DataFrame:
    """(key, path, parent, level, title, content, references, entities): valid items of a JSON reply.

    A reply that is no such JSON gives no row. An item with ``is_valid`` false is left out
    with everything below it. ``path`` numbers the items from 0 and identifies them.
    Children are followed level by level, as long as there are any; ``RuntimeError`` if
    there are more than ``depth`` levels.
    """
    top = replies.select(key, F.from_json(reply, "struct<data:struct<items:array<string>>>").alias("r")).select(key, F.posexplode("r.data.items").alias("i", "item"))
    now = top.select(key, F.col("i").cast("string").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), "item")
    out = None
    for level in range(depth):
        parsed = now.withColumn("item", F.from_json("item", f"struct<{_LEAF}>")).where(F.col("item").isNotNull() & F.coalesce("item.is_valid", F.lit(True)))
        now = cut(parsed)
        flat = now.select(key, "path", "parent", "level", *(F.col(f"item.{c}").alias(c) for c in ("title", "content", "references", "entities")))
        out = flat if out is None else out.unionByName(flat)
        below = now.select(key, "path", F.posexplode("item.children").alias("i", "child"))
        if below.isEmpty():
            return out
        now = below.select(key, F.concat_ws(".", "path", F.col("i").cast("string")).alias("path"), F.col("path").alias("parent"), F.lit(level + 1).alias("level"), F.col("child").alias("item"))
    raise RuntimeError(f"items have children on more than {depth} levels")


def resolve_references(references: Column, ids: Column) -> Column:
    """1-based numbers to ids; without a usable one all ids."""
    numbers = F.filter(F.transform(references, lambda r: r.try_cast("int")), lambda n: n.between(1, F.size(ids)))
    chosen = F.transform(numbers, lambda n: F.element_at(ids, n))
    return F.when(F.size(chosen) > 0, F.array_distinct(chosen)).otherwise(ids)


def entity_id(source: Column, kind: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, kind, key), 256), 1, 32)


def distinct_entities(mentions: DataFrame, source: str, kind: str, name: str, order: str) -> DataFrame:
    """(id, source, kind, key, name, mentions): one entity for each source, type and folded name.

    The first mention gives the name; names of one character and null parts are dropped.
    """
    named = mentions.where(F.col(source).isNotNull() & F.col(kind).isNotNull() & (F.length(F.trim(name)) > 1))
    keyed = named.select(F.col(source).alias("source"), F.col(kind).alias("kind"), F.lower(F.trim(name)).alias("key"), F.trim(name).alias("name"), F.col(order).alias("_o"))
    first = keyed.groupBy("source", "kind", "key").agg(F.min_by("name", F.struct("_o", "name")).alias("name"), F.count(F.lit(1)).alias("mentions"))
    return first.select(entity_id(F.col("source"), F.col("kind"), F.col("key")).alias("id"), "source", "kind", "key", "name", "mentions")


def merged_descriptions(rows: DataFrame, keys: list[str], description: str, order: list[str], mark: str = "、") -> DataFrame:
    """(keys, descriptions): distinct descriptions, joined in order of their first occurrence."""
    filled = rows.where(F.trim(F.coalesce(description, F.lit(""))) != "")
    first = filled.groupBy(*keys, F.col(description).alias("d")).agg(F.min(F.struct(*order)).alias("o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: x["d"])
    return first.groupBy(*keys).agg(F.array_join(listed, mark).alias("descriptions"))


def unknown_types(items: DataFrame, allowed: DataFrame, kind: str) -> DataFrame:
    """Items whose type is not among the allowed ones."""
    return items.join(allowed.select(kind).distinct(), kind, "left_anti")


def resolved_types(parts: list[DataFrame]) -> DataFrame:
    """Entity types of several tables with the same columns: the first table that has a type gives it.

    Tables have a column ``type``; within a table the smallest row of a type counts.
    """
    marked = [p.withColumn("_prio", F.lit(i)) for i, p in enumerate(parts)]
    both = marked[0]
    for p in marked[1:]:
        both = both.unionByName(p)
    others = [c for c in both.columns if c not in ("type", "_prio")]
    first = both.where("type is not null").groupBy("type").agg(F.min(F.struct("_prio", *others)).alias("_r"))
    return first.select("type", *(F.col(f"_r.{c}").alias(c) for c in others))


def over_type_threshold(hits: DataFrame, types: DataFrame, default: float = 0.8) -> DataFrame:
    """Hits (with type and score) at or over the threshold of their type, and the type's weight.

    ``types`` has type, threshold and weight; a type that is unknown, or without a
    threshold or weight, has ``default`` and 1.
    """
    known = types.select("type", "threshold", "weight")
    joined = hits.join(known, "type", "left").withColumns({"threshold": F.coalesce("threshold", F.lit(default)), "weight": F.coalesce("weight", F.lit(1.0))})
    return joined.where(F.col("score") >= F.col("threshold"))


def created_of_source(items: DataFrame, articles: DataFrame, key: str = "article_id", time: str = "created_time") -> DataFrame:
    """Items with the creation time of their article; null where it is unknown."""
    first = articles.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(time).alias("source_created_time"))
    return items.join(first, key, "left")
