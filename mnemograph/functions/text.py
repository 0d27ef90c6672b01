"""Text scalars as column expressions; Python only where Spark has no function."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ELLIPSIS = "..."


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).lower().split()))


#: NFKC, lower case, single blanks; null stays null
normalize_for_embedding = F.pandas_udf(_nfkc, StringType())


def entity_key(name: Column) -> Column:
    """Lower case without anything but letters, digits, underscores and blanks."""
    return squeeze(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\p{M}_\s]", ""))


def headings(text: Column) -> Column:
    """The markdown headings of a text, without marks, in order."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    marked = F.filter(lines, lambda x: x.rlike(r"^#{1,6}\s+.+"))
    return F.transform(marked, lambda x: F.trim(F.regexp_replace(x, r"^#{1,6}\s+", "")))


def truncate(text: Column, most: int, suffix: str = ELLIPSIS) -> Column:
    """At most ``most`` characters, the suffix included."""
    cut = F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def heading_text(text: Column, most: int = 500) -> Column:
    """A heading without leading hashes and link targets, capped."""
    plain = squeeze(F.regexp_replace(F.regexp_replace(F.trim(text), r"^#+\s*", ""), r"\[([^\]]+)\]\([^)]*\)", "$1"))
    cut = F.concat(F.rtrim(F.substring(plain, 1, most - 3)), F.lit(ELLIPSIS))
    return F.when(F.length(plain) <= most, plain).otherwise(cut)


def paragraphs(text: Column) -> Column:
    """Trimmed paragraphs without blank ones."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]"))


def estimate_tokens(text: Column) -> Column:
    """floor(cjk / 1.5 + rest / 4), in whole numbers."""
    c = cjk_count(text)
    return F.floor((c * 8 + (F.length(text) - c) * 3) / F.lit(12)).cast("bigint")


def estimate_model_tokens(text: Column, cjk: float = 1.5, latin: float = 4.0, other: float = 2.0) -> Column:
    """Tokens by character classes, at least one: CJK, Latin letters and digits, everything else but blanks."""
    c = cjk_count(text)
    latins = F.regexp_count(text, F.lit("[A-Za-z0-9]"))
    rest = F.length(F.regexp_replace(text, r"[A-Za-z0-9\s一-鿿]", ""))
    return F.greatest(F.lit(1), F.floor(c / F.lit(cjk) + latins / F.lit(latin) + rest / F.lit(other))).cast("bigint")


def clean_lines(text: Column) -> Column:
    """Single blanks within lines, at most one empty line in a row, trimmed lines."""
    single = F.regexp_replace(text, "[ \\t]+", " ")
    few = F.regexp_replace(single, "\n{3,}", "\n\n")
    return F.trim(F.array_join(F.transform(F.split(few, "\n"), lambda x: F.trim(x)), "\n"))


# fixed values: ASCII punctuation and English articles that answers are compared without
_PUNCTUATION = "[!-/:-@\\[-`{-~]"
ARTICLES = ("a", "an", "the")


def answer_tokens(text: Column) -> Column:
    """Words of an answer: lower case, without ASCII punctuation and articles."""
    words = F.split(squeeze(F.regexp_replace(F.lower(text), _PUNCTUATION, "")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*ARTICLES))


def normalize_answer(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda x: F.trim(x)), lambda s: s.rlike(r"\S"))


def section_text(heading: Column, content: Column) -> Column:
    """Heading and content; a first content line that repeats the heading is dropped."""
    first = F.trim(F.regexp_replace(F.element_at(F.split(content, "\n"), 1), "^#+", ""))
    rest = F.regexp_replace(content, "^[^\n]*\n?", "")
    body = F.when(first == F.trim(heading), rest).otherwise(content)
    return F.trim(F.concat_ws("\n", F.coalesce(heading, F.lit("")), F.coalesce(body, F.lit(""))))


def evidence_text(text: Column) -> Column:
    """Comparable form of a passage: lower case, squeezed lines, at most one empty line in a row."""
    few = F.regexp_replace(F.trim(text), "\n{3,}", "\n\n")
    lines = F.transform(F.split(few, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.lower(F.array_join(lines, "\n"))


def rerank_text(title: Column, content: Column, fallback: Column) -> Column:
    """Title and content without blanks, else the id."""
    parts = F.filter(F.array(F.trim(title), F.trim(content)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.nullif(F.array_join(parts, "\n"), F.lit("")), fallback)


def embedding_input(heading: Column, content: Column, most: int) -> Column:
    return F.concat(F.coalesce(heading, F.lit("")), F.lit("\n\n"), F.substring(F.coalesce(content, F.lit("")), 1, most))


def extract_answer(text: Column, mark: str = "answer:") -> Column:
    """What follows the last mark, whatever its case; the whole text without one."""
    after = F.substring_index(F.lower(text), mark, -1)
    return F.trim(F.when(F.instr(F.lower(text), mark) > 0, F.right(text, F.length(after))).otherwise(text))


def qa_prompt(passages: Column, question: Column, top: int) -> Column:
    """A prompt of the first passages and the question."""
    shown = F.transform(F.slice(passages, 1, top), lambda p: F.concat(F.lit("Wikipedia Title: "), p, F.lit("\n\n")))
    return F.concat(F.array_join(shown, ""), F.lit("Question: "), question, F.lit("\nThought: "))


def first_filled(values: Column) -> Column:
    """The first value that is not blank."""
    return F.get(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")), F.lit(0))


def strip_fence(text: Column) -> Column:
    """JSON out of a fenced block; other texts are trimmed."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


def ground_truths(value: Column) -> Column:
    """Answers of a polymorphic field: a JSON array of strings, a JSON string, or bare text."""
    many = F.from_json(value, "array<string>")
    one = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")
    shaped = F.when(value.startswith("["), many).when(value.startswith('"'), one)
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(shaped, F.array(value)))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def _uuid5(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, v)))


#: deterministic id of a text
text_id = F.pandas_udf(_uuid5, StringType())
