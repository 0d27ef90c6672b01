"""Texts to sections to chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEADING = re.compile(r"^#{1,6}\s+(.+)$", re.M)
# fixed values: delimiters, of which at each place the first that fits ends a piece
PRIMARY = ("\r\n\r\n", "\n\n", "\r\n", "\n", "\r", "。", "！", "？", "!", "?", ". ")
SECONDARY = ("，", ",", "、", "；", ";")
#: bounds of the size of a chunk, the size over which a section stands alone, and the least size of a section
LEAST_TOKENS, MOST_TOKENS, ALONE_TOKENS, LEAST_SECTION = 64, 1000, 600, 32
#: characters a chunk must have to be worth an extraction
LEAST_CHARACTERS = 20
CHUNKS = "doc string, rank int, n_sections int, n_tokens int, heading string, content string, section_type string, section_order_indices array<int>"
SECTIONS = "doc string, order_index int, render_group_index int, heading string, content string"


def heading_sections(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, heading, content): a section for each heading line; what stands before is section 0.

    Lines are exploded and summed up per document; a document's lines are sorted in Spark,
    which spills, and never held as Python objects.
    """
    lines = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    is_heading = F.trim("line").rlike(r"^#{1,6}\s+.+")
    order = Window.partitionBy(key).orderBy("i")
    numbered = lines.withColumn("is_heading", is_heading).withColumn("section", F.sum(F.col("is_heading").cast("int")).over(order))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("i", "line")))), lambda x: x["line"])
    title = F.max(F.when(F.col("is_heading"), F.trim(F.regexp_replace(F.trim("line"), r"^#{1,6}\s+", ""))))
    sections = numbered.groupBy(key, "section").agg(F.coalesce(title, F.lit("")).alias("heading"), F.trim(F.array_join(body, "\n"), F.lit(" \n")).alias("content"))
    return sections.where("heading != '' or content != ''")


def previous(rows: DataFrame, key: str, rank: str, *columns: str) -> DataFrame:
    """Adds the columns of the row before, by rank within the key."""
    order = Window.partitionBy(key).orderBy(rank)
    return rows.withColumns({f"previous_{c}": F.lag(c).over(order) for c in columns})


def tokens_of(text: str) -> int:
    c = sum("一" <= x <= "鿿" for x in text)
    return (8 * c + 3 * (len(text) - c)) // 12


def blocks(text: str) -> list[tuple[str, str]]:
    """(heading, body) of a markdown text; the body before the first heading has none; empty ones are dropped."""
    marks = list(_HEADING.finditer(text))
    out = [("", text[: marks[0].start()] if marks else text)]
    for m, following in zip(marks, marks[1:] + [None]):
        out.append((m.group(1).strip(), text[m.end() : following.start() if following else len(text)]))
    return [(h, b.strip()) for h, b in out if b.strip() or h]


def _pieces(text: str, delimiters: tuple[str, ...]) -> list[str]:
    """The text cut behind every delimiter; blank pieces go with the piece before, or the first one."""
    ends = re.compile("|".join(map(re.escape, delimiters)))
    at = [0, *(m.end() for m in ends.finditer(text))]
    out: list[str] = []
    for low, high in zip(at, at[1:] + [len(text)]):
        piece = text[low:high]
        if out and (not piece.strip() or not out[-1].strip()):
            out[-1] += piece
        elif piece:
            out.append(piece)
    return out or [text]


def _fitting(text: str, limit: int) -> int:
    """The most characters, at least one, with which the text is within the limit."""
    low, high = 1, len(text)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if tokens_of(text[:middle]) <= limit else (low, middle - 1)
    return low


def split_text(text: str, limit: int) -> list[str]:
    """Pieces that join to the text: behind primary delimiters, then, where one is over the
    limit, behind secondary ones, and at last between characters."""
    out: list[str] = []
    for piece in _pieces(text, PRIMARY):
        for part in [piece] if tokens_of(piece) <= limit else _pieces(piece, SECONDARY):
            while tokens_of(part) > limit:
                n = _fitting(part, limit)
                out.append(part[:n])
                part = part[n:]
            out.append(part)
    return [x for x in out if x] or [text]


def block_sections(documents: DataFrame, key: str, text: str, section_tokens: int = 256) -> DataFrame:
    """(doc, order_index, render_group_index, heading, content): the sections of each markdown text.

    Blocks under headings are cut to sections of at most ``section_tokens`` (32 at least);
    blank sections go with their neighbour. ``order_index`` counts from 0,
    ``render_group_index`` is the number of a block's first section from 1. Null texts give
    none. A document is read whole by one task, which holds no other.
    """
    limit = max(LEAST_SECTION, section_tokens)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, value in zip(batch.doc, batch.text):
                found = [(heading, piece, i) for i, (heading, body) in enumerate(blocks(value)) for piece in (split_text(body, limit) if body else [])]
                first: dict[int, int] = {}
                for at, (heading, piece, block) in enumerate(found):
                    rows.append((doc, at, first.setdefault(block, at + 1), heading, piece))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTIONS.split(", ")])

    texts = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("doc"), F.col(text).alias("text"))
    return texts.mapInPandas(cut, SECTIONS)


class _Packer:
    """The open chunk of one document: sections are added until it is full."""

    def __init__(self, limit: int, heading_strict: bool):
        self.limit, self.heading_strict = limit, heading_strict
        self.doc, self.rank, self.open, self.size = None, 0, [], 0

    def close(self) -> list[tuple]:
        if not self.open:
            return []
        content = "\n".join(text for _, _, text, _ in self.open).strip()
        heading = next((h for _, h, _, _ in self.open if h), "")
        row = (self.doc, self.rank, len(self.open), tokens_of(content), heading, content, self.open[0][3], [i for i, *_ in self.open])
        self.rank, self.open, self.size = self.rank + 1, [], 0
        return [row]

    def add(self, doc: str, index: int, heading: str, text: str, kind: str) -> list[tuple]:
        out = []
        if doc != self.doc:
            out += self.close()
            self.doc, self.rank = doc, 0
        text = text.strip()
        size = tokens_of(text)
        alone = size > ALONE_TOKENS
        if alone or (self.open and (self.size + size > self.limit or (self.heading_strict and heading != self.open[0][1]))):
            out += self.close()
        if not alone:
            self.open.append((index, heading, text, kind))
            self.size += size
            return out
        packed: list[str] = []
        room = self.limit
        for paragraph in text.split("\n\n"):
            n = tokens_of(paragraph)
            if packed and n > room:
                self.open = [(index, heading, "\n\n".join(packed), kind)]
                out += self.close()
                packed, room = [], self.limit
            packed.append(paragraph)
            room -= n
        self.open = [(index, heading, "\n\n".join(packed), kind)]
        return out + self.close()


def assemble_chunks(sections: DataFrame, doc: str, index: str, heading: str, content: str, max_tokens: int = 1000, kind: str | None = None, heading_strict: bool = False) -> DataFrame:
    """Greedy packing of a document's sections, in order, into chunks of at most ``max_tokens`` (64 to 1000).

    A section of over 600 tokens stands alone and is packed by its paragraphs; a paragraph
    over the limit stays whole. With ``heading_strict`` a chunk ends where the heading
    changes. A chunk has the first heading that is not empty. Sections are sorted within
    partitions and read as a stream; only the open chunk is kept, so a document with very
    many sections needs no more memory than another. Null contents and headings are empty;
    rows without a document are left out; equal indices go by their content.
    """
    limit = min(MOST_TOKENS, max(LEAST_TOKENS, max_tokens))
    empty = F.lit("")
    rows = sections.where(F.col(doc).isNotNull()).select(
        F.col(doc).cast("string").alias("doc"), F.col(index).cast("int").alias("at"), F.coalesce(heading, empty).alias("heading"), F.coalesce(content, empty).alias("content"),
        (F.lit("TEXT") if kind is None else F.coalesce(kind, F.lit("TEXT"))).alias("kind"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = _Packer(limit, heading_strict)
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        for batch in batches:
            out = [r for x in batch.itertuples(index=False) for r in packer.add(*x)]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if last := packer.close():
            yield pd.DataFrame(last, columns=columns)

    return rows.repartition("doc").sortWithinPartitions("doc", "at", "content").mapInPandas(pack, CHUNKS)


def load_documents(documents: DataFrame, key: str, text: str, max_tokens: int = 1000, section_tokens: int = 256, heading_strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles, sections and chunks of markdown texts, each with deterministic ids.

    The articles are (article_id, title), by their first heading; sections and chunks are
    those of ``block_sections`` and ``assemble_chunks``, a chunk with ``references``, the
    ids of its sections. Chunks shorter than ``LEAST_CHARACTERS`` are kept and marked not
    ``worth_extraction``.
    """
    from mnemograph.functions.text import heading_text, headings

    titles = documents.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("article_id"), F.coalesce(heading_text(F.get(headings(F.col(text)), F.lit(0))), F.lit("Untitled")).alias("title"))
    cut = block_sections(documents, key, text, section_tokens)
    section_id = lambda doc, at: chunk_id(doc, F.concat(F.lit("s"), at.cast("string")))
    sections = cut.withColumn("section_id", section_id(F.col("doc"), F.col("order_index"))).withColumnRenamed("doc", "article_id")
    packed = assemble_chunks(cut, "doc", "order_index", "heading", "content", max_tokens, heading_strict=heading_strict)
    references = F.transform("section_order_indices", lambda i: section_id(F.col("doc"), i))
    chunks = packed.select(
        chunk_id(F.col("doc"), F.col("rank")).alias("chunk_id"), F.col("doc").alias("article_id"), "rank", "heading", "content", "n_tokens", references.alias("references"),
        long_enough(F.col("content")).alias("worth_extraction"),
    )
    return titles, sections, chunks


def long_enough(content: Column, least: int = LEAST_CHARACTERS) -> Column:
    """Is there enough of a chunk to extract from."""
    return F.coalesce(F.length(content) >= least, F.lit(False))


def chunk_id(article: Column, rank: Column) -> Column:
    """A deterministic id, so that a repeated load replaces instead of adding."""
    return F.substring(F.sha2(F.concat_ws("|", article, rank.cast("string")), 256), 1, 32)
