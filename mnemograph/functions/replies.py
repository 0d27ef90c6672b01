"""What models reply: JSON with fallbacks, clean lists, ratings, contexts and contracts of extracted items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.functions.values import stripped

GRAPH_MARK = "-----"
#: fields of a compact reply: of an item and of its entities
ITEM_FIELDS, ENTITY_FIELDS = ("title", "content", "entities", "is_valid"), ("type", "name", "description")


def preprocess_context(parts: Column, top_k: int = 5) -> Column:
    """Passages of a context: graph contexts stay whole, others are their first ``top_k`` paragraphs.

    ``parts`` is array<string>, of which empty and null ones are dropped; a blank or null
    context gives an empty list, ``top_k`` of 0 or less keeps everything in one.
    """
    whole = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n\n")
    chunks = F.filter(F.transform(F.split(whole, "\n\n"), stripped), lambda x: x != "")
    kept = F.array(whole) if top_k <= 0 else F.when(F.startswith(stripped(whole), F.lit(GRAPH_MARK)), F.array(whole)).otherwise(F.slice(chunks, 1, max(1, top_k)))
    return F.when(parts.isNull() | (stripped(whole) == ""), F.array().cast("array<string>")).otherwise(kept)


def without_fences(text: Column) -> Column:
    return stripped(F.regexp_replace(text, "```(?:json)?", ""))


def clean_list(items: Column) -> Column:
    """Trimmed strings of a list without blank ones."""
    return F.filter(F.transform(items, stripped), lambda x: x.isNotNull() & (x != ""))


def _list_under(text: Column, key: str) -> Column:
    """The list of strings under a key of a JSON object; null where the text is none or lacks the key."""
    held = F.try_variant_get(F.try_parse_json(text), f"$.{key}", "variant")
    as_list = F.coalesce(F.from_json(held.cast("string"), "array<string>"), F.array().cast("array<string>"))
    return F.when(held.isNotNull(), clean_list(as_list))


def parse_list(text: Column, key: str) -> Column:
    """The list under ``key`` of a reply, tried in order: the whole text, its outermost braces, its first brackets.

    Code fences are dropped before; what is no list is empty, as is a null text.
    """
    plain = without_fences(text)
    braces = F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit(""))
    brackets = F.nullif(F.regexp_extract(plain, r"(?s)\[(.*?)\]", 1), F.lit(""))
    items = F.transform(F.split(brackets, r",\s*"), lambda x: F.regexp_replace(x, "^[ \"']+|[ \"']+$", ""))
    return F.coalesce(_list_under(plain, key), _list_under(braces, key), clean_list(items), F.array().cast("array<string>"))


def _rating(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.between(0, 2), number)


def rating_of(text: Column) -> Column:
    """A rating from 0 to 2: of a JSON object (rating or score), a JSON list of one, a bare number, or the first of eight words that is one."""
    plain = without_fences(text)
    json = F.try_parse_json(plain)
    held = lambda name: F.try_variant_get(json, f"$.{name}", "double")
    many = F.from_json(plain, "array<double>")
    words = F.transform(F.slice(F.split(plain, r"\s+"), 1, 8), _rating)
    first = F.get(F.filter(words, lambda x: x.isNotNull()), F.lit(0))
    in_object = F.when(F.startswith(plain, F.lit("{")), _rating(F.coalesce(held("rating"), held("score"))))
    in_list = F.when(F.startswith(plain, F.lit("[")) & (F.size(many) == 1), _rating(F.get(many, F.lit(0))))
    return F.coalesce(in_object, in_list, _rating(plain), first)


def mean_rating(first: Column, second: Column) -> Column:
    """The mean of the two ratings, halved to 0..1, without missing ones; NaN if both are missing."""
    halves = F.filter(F.array(first / 2, second / 2), lambda x: x.isNotNull())
    total = F.aggregate(halves, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(halves) > 0, total / F.size(halves)).otherwise(F.lit(float("nan")))


def attributed_ratio(marks: Column) -> Column:
    """The share of marks (array of 0 and 1) that are 1; NaN without any."""
    known = F.filter(marks, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(F.lit(float("nan")))


def _keys(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def _filled(value: Column) -> Column:
    return F.coalesce(stripped(value), F.lit("")) != ""


def contract_errors(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, errors): what a compact reply violates, an empty list for a sound one.

    ``data`` may hold ``items`` only, and exactly one item; an item has title, content,
    entities and is_valid and nothing else, its texts are not blank and a valid one has
    entities; an entity has type, name and description, all filled, and nothing else.
    Errors name the fault and, of an entity, its number.
    """
    string_list = "array<string>"
    row = replies.select(key, F.get_json_object(reply, "$.data").alias("data"))
    row = row.withColumn("items", F.from_json(F.get_json_object("data", "$.items"), string_list))
    row = row.withColumn("item", F.get("items", F.lit(0)))
    held = {f: F.get_json_object("item", f"$.{f}") for f in ITEM_FIELDS}
    row = row.withColumns({**held, "list": F.from_json(F.get_json_object("item", "$.entities"), string_list)})
    fault = lambda when, text: F.when(when, F.lit(text))
    extra = lambda keys, allowed, says: F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, allowed)))), lambda f: F.concat(F.lit(says), f))

    def of_entity(entity: Column, i: Column) -> Column:
        at = F.concat(F.lit("entity "), i.cast("string"), F.lit(": "))
        missing = [F.when(~_filled(F.get_json_object(entity, f"$.{f}")), F.lit(f"no {f}")) for f in ENTITY_FIELDS]
        faults = F.concat(extra(_keys(entity), ENTITY_FIELDS, "forbidden "), F.array_compact(F.array(*missing)))
        return F.transform(faults, lambda x: F.concat(at, x))

    n_items = F.coalesce(F.size("items"), F.lit(0))
    valid = F.col("is_valid")
    single = [
        fault(F.col("items").isNull(), "items is no list"), fault(F.col("items").isNotNull() & (n_items != 1), "not exactly one item"),
        *(fault((n_items > 0) & ~_filled(F.col(f)), f"no {f}") for f in ("title", "content")),
        fault((n_items > 0) & ~F.coalesce(valid.isin("true", "false"), F.lit(False)), "is_valid is no boolean"),
        fault((n_items > 0) & F.col("list").isNull(), "entities is no list"),
        fault((n_items > 0) & (valid == "true") & (F.coalesce(F.size("list"), F.lit(0)) <= 0), "a valid item without entities"),
    ]
    errors = F.concat(
        extra(_keys(F.col("data")), ("items",), "forbidden in data "), F.array_compact(F.array(*single)), extra(_keys(F.col("item")), ITEM_FIELDS, "forbidden "),
        F.coalesce(F.flatten(F.transform("list", of_entity)), F.array().cast(string_list)),
    )
    return row.select(key, errors.alias("errors"))


def quality_counts(items: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """(key, n_items, no_references, no_title, no_content, unknown_types): faults of flat items that do not stop a run.

    ``items`` are those of ``flatten_events``, children included; types are compared with
    ``allowed`` and listed in order.
    """
    blank = lambda c: F.sum((~_filled(F.col(c))).cast("int"))
    types = F.transform(F.coalesce("entities", F.array().cast("array<struct<type:string,name:string,description:string>>")), lambda e: e["type"])
    unknown = F.filter(types, lambda t: t.isNotNull() & (t != "") & ~t.isin(*allowed))
    return items.withColumn("_u", unknown).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum((F.coalesce(F.size("references"), F.lit(0)) <= 0).cast("int")).alias("no_references"), blank("title").alias("no_title"), blank("content").alias("no_content"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_u")))).alias("unknown_types"),
    )
