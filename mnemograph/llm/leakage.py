"""Evaluation passages that occur in a training corpus (problem 6).

The corpus is indexed shard by shard: a shard is a run of rows of one input partition, up
to ``shard_words`` words, so the text is never shuffled. Every window of ``min_words``
words of the evaluation passages is searched backwards through each shard's FM-index,
found windows are located by sampled suffix positions and merged to removal spans.

Only words of the passages can match, so a shard's index holds the stretches of at least
``min_words`` such words; a shorter stretch cannot hold a match. Nothing is cut off.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.session import cut

from mnemograph.llm.fm_index import FMIndex

WORD = re.compile(r"[^\W_]+")
_WORD_OR_BREAK = re.compile("[^\\W_]+|\x01")
SPANS = "doc_id bigint, sample_id bigint, start_word int, n_words int"


class Phrases:
    """Every ``width``-word window of the passages, once, with the samples that hold it."""

    def __init__(self, passages: list[tuple[int, str]], width: int):
        self.width = width
        self.ids: dict[str, int] = {}
        codes, sizes = array("q"), []
        for _, text in passages:
            before = len(codes)
            codes.extend(self.ids.setdefault(w, len(self.ids) + 1) for w in WORD.findall(text.lower()))
            sizes.append(len(codes) - before)
        flat = np.array(codes, np.int64)
        ends = np.cumsum(sizes, dtype=np.int64) if sizes else np.empty(0, np.int64)
        starts = np.arange(len(flat))
        passage = np.repeat(np.arange(len(sizes)), sizes)
        whole = starts + width <= ends[passage] if len(flat) else np.empty(0, bool)
        starts, passage = starts[whole], passage[whole]
        every = np.lib.stride_tricks.sliding_window_view(flat, width)[starts] if len(starts) else np.empty((0, width), np.int64)
        self.windows, which = np.unique(every, axis=0, return_inverse=True)
        owner = np.array([s for s, _ in passages], np.int64)[passage] if len(passages) else np.empty(0, np.int64)
        pairs = np.unique(np.stack([which.reshape(-1), owner], axis=1), axis=0)
        self.samples = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))


def _merged(doc: np.ndarray, sample: np.ndarray, start: np.ndarray, width: int) -> pd.DataFrame:
    """Overlapping or touching windows of one document and sample become one span."""
    order = np.lexsort((start, sample, doc))
    doc, sample, start = doc[order], sample[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sample[1:] != sample[:-1]) | (start[1:] > start[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return pd.DataFrame({"doc": doc[first], "sample_id": sample[first], "start_word": start[first], "n_words": start[last] - start[first] + width})


def search_shard(texts: list[str], phrases: Phrases) -> pd.DataFrame:
    """Spans (doc, sample_id, start_word, n_words) of one shard; doc counts from 0."""
    joined = "\x01".join(t.replace("\x01", " ") for t in texts).lower()
    words = _WORD_OR_BREAK.findall(joined)
    get = phrases.ids.get
    symbols = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    breaks = np.flatnonzero(np.fromiter((w == "\x01" for w in words), bool, len(words)))
    known = np.concatenate([[0], (symbols > 0).astype(np.int8), [0]])
    edge = np.diff(known)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= phrases.width
    begin, end = begin[long], end[long]
    if not len(begin):
        return _merged(*[np.empty(0, np.int64)] * 3, phrases.width)
    # kept stretches, each with one separator behind it
    sizes = end - begin + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    origin = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(begin, sizes)
    text = np.append(symbols, 0)[origin]
    text[offsets[1:] - 1] = 0
    index = FMIndex(text, len(phrases.ids) + 1)
    found, low, high = index.search(phrases.windows)
    hits = high - low
    rows = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
    at = origin[index.locate(rows)]
    window = np.repeat(found, hits)
    doc = np.searchsorted(breaks, at)
    start = at - np.concatenate([[0], breaks + 1])[doc]
    owners = phrases.first[window + 1] - phrases.first[window]
    which = np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners) + np.repeat(phrases.first[window], owners)
    return _merged(np.repeat(doc, owners), phrases.samples[which], np.repeat(start, owners), phrases.width)


def passages(samples: DataFrame) -> DataFrame:
    """(sample_id, text): the question and every paragraph text of each sample."""
    question = samples.select(F.col("id").alias("sample_id"), F.col("question").alias("text"))
    paragraphs = samples.select(F.col("id").alias("sample_id"), F.explode("paragraphs.text").alias("text"))
    return question.unionByName(paragraphs).where("sample_id is not null and text is not null").distinct()


def leaked_spans(documents: DataFrame, samples: DataFrame, min_words: int = 12, shard_words: int = 1_000_000, max_eval_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, sample_id, start_word, n_words): maximal shared stretches of words.

    A word is a run of letters or digits of the lower-cased text; ``start_word`` counts a
    document's words from 0. Null texts and ids hold nothing, repeated documents are
    reported each, a sample text of fewer than ``min_words`` words cannot leak, and empty
    tables give an empty result. Other columns are ignored.

    Evaluation text is sent to every task in parts of at most ``max_eval_chars``
    characters, so what the driver and the tasks hold is bounded; a larger evaluation set
    takes one pass over the corpus for each part, one after another, whose spans are
    written down before the next begins.
    """
    spark = documents.sparkSession
    phrases = passages(samples)
    n_chars = phrases.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-n_chars // max_eval_chars) or 1
    docs = documents.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null and text is not null")
    out = None
    for part in range(parts):
        chosen = phrases if parts == 1 else phrases.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(Phrases([(r.sample_id, r.text) for r in chosen.collect()], min_words))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            def searched(ids: list[int], texts: list[str]) -> pd.DataFrame:
                spans = search_shard(texts, shared.value)
                spans.insert(0, "doc_id", np.array(ids, np.int64)[spans.pop("doc").to_numpy()])
                return spans

            ids: list[int] = []
            texts: list[str] = []
            room = shard_words * 6
            for batch in batches:
                for doc, text in zip(batch.doc_id, batch.text):
                    ids.append(doc)
                    texts.append(text)
                    room -= len(text)
                    if room <= 0:
                        yield searched(ids, texts)
                        ids, texts, room = [], [], shard_words * 6
            if ids:
                yield searched(ids, texts)

        spans = docs.mapInPandas(scan, SPANS)
        if parts > 1:
            spans = cut(spans)
            shared.destroy()
        out = spans if out is None else out.unionByName(spans)
    return out


def leaked_documents(documents: DataFrame, samples: DataFrame, **options) -> DataFrame:
    """(doc_id, sample_id), once each, of ``leaked_spans``."""
    return leaked_spans(documents, samples, **options).select("doc_id", "sample_id").distinct()


def removal_spans(documents: DataFrame, samples: DataFrame, **options) -> DataFrame:
    """(doc_id, start_word, n_words, sample_ids): spans to cut from each document.

    Spans of different samples that overlap or touch are merged; the work is grouped by
    document, whose spans are few.
    """
    spans = leaked_spans(documents, samples, **options)
    from pyspark.sql import Window

    ordered = Window.partitionBy("doc_id").orderBy("start_word", "sample_id")
    reach = F.max(F.col("start_word") + F.col("n_words")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("start_word") > reach), 1).otherwise(0))
    return (
        marked.withColumn("span", F.sum("new").over(ordered))
        .groupBy("doc_id", "span")
        .agg(
            F.min("start_word").alias("start_word"),
            (F.max(F.col("start_word") + F.col("n_words")) - F.min("start_word")).alias("n_words"),
            F.array_sort(F.collect_set("sample_id")).alias("sample_ids"),
        )
        .drop("span")
    )
