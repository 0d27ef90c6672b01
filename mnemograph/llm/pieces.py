"""Items over a size limit cut into overlapping pieces at natural boundaries (problem 5).

Balanced targets: the least number of pieces that could hold the item is computed, that
many equally long pieces are targeted, each target is snapped to the strongest boundary
near it, and pieces are added when any of them would break the limit.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.session import table

PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE = 5, 4, 3, 2, 1
PIECES = "array<struct<start:int,end:int,size:int,text:string>>"
# fixed values: characters that end sentences and clauses, and closers that may follow them
SENTENCE_END, CLAUSE_END, CLOSERS = ".!?…", ",;:", "\"'”’»)]"
CJK_SENTENCE_END, CJK_CLAUSE_END = "。！？", "，；：、"
# tables, their id columns and limited fields
ITEMS = (("structured_block", "block_id", "raw_content"), ("section_draft", "section_id", "content"), ("chunk_draft", "chunk_id", "content"))


def size_column(text: Column) -> Column:
    """floor(c / 1.5 + (n - c) / 4) of n characters, c of them in U+4E00 to U+9FFF."""
    n = F.length(text).cast("bigint")
    c = n - F.length(F.regexp_replace(text, "[\\u4e00-\\u9fff]", ""))
    return F.floor((c * 8 + (n - c) * 3) / F.lit(12))


def _codes(characters: str) -> np.ndarray:
    return np.array([ord(x) for x in characters], np.uint32)


def _boundaries(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut is natural and how strong each is."""
    n = len(code)
    strength = np.zeros(n + 1, np.int8)
    strength[1:][np.isin(code, _codes(CJK_CLAUSE_END))] = CLAUSE
    strength[1:][np.isin(code, _codes(CJK_SENTENCE_END))] = SENTENCE
    space = np.isin(code, _codes(" \t\n\r\f\v 　  "))
    at = np.flatnonzero(space[:-1] & ~space[1:]) + 1 if n else np.empty(0, np.int64)
    solid = np.maximum.accumulate(np.where(space, -1, np.arange(n)))
    last = solid[at - 1]
    lines = np.concatenate([[0], np.cumsum(code == 10)])
    n_lines = lines[at] - lines[last + 1]
    closer = np.isin(code, _codes(CLOSERS))
    inner = np.maximum.accumulate(np.where(space | closer, -1, np.arange(n)))
    before = code[np.maximum(np.where(last >= 0, inner[np.maximum(last, 0)], 0), 0)]
    found = np.full(len(at), SPACE, np.int8)
    found[np.isin(before, _codes(CLAUSE_END))] = CLAUSE
    found[np.isin(before, _codes(SENTENCE_END))] = SENTENCE
    found[n_lines == 1] = LINE
    found[n_lines > 1] = PARAGRAPH
    strength[at] = np.maximum(found, strength[last + 1])
    strength[[0, n]] = 0
    positions = np.flatnonzero(strength)
    return positions, strength[positions]


class _Text:
    def __init__(self, text: str, limit: int, overlap: int):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cjk = (code >= 0x4E00) & (code <= 0x9FFF)
        #: size in twelfths of a token before each position
        self.weight = np.concatenate([[0], np.cumsum(np.where(cjk, 8, 3))])
        self.cap = 12 * limit + 11
        self.overlap = 12 * min(overlap, limit // 2)
        self.positions, self.strength = _boundaries(code)
        self.places = self.weight[self.positions]

    def snap(self, target: float, low: float, high: float, after: int, before: int, earlier: bool = False) -> int | None:
        """The strongest boundary of weight low..high, nearest to target, in after < p <= before.

        Without one the last boundary before it, if ``earlier`` allows that (a later one
        would leave too few positions for the pieces behind), and without any the position
        nearest to the target; None if there is no room.
        """
        i, j = np.searchsorted(self.places, [low, high], ("left"))
        j = np.searchsorted(self.places, high, "right")
        inside = (self.positions[i:j] > after) & (self.positions[i:j] <= before)
        if inside.any():
            places, strength = self.places[i:j][inside], self.strength[i:j][inside]
            best = np.lexsort((np.abs(places - target), -strength))[0]
            return int(self.positions[i:j][inside][best])
        if earlier and j > 0 and after < self.positions[j - 1] <= before:
            return int(self.positions[j - 1])
        p = int(np.searchsorted(self.weight, min(target, high), "right")) - 1
        p = min(max(p, after + 1), before)
        return p if after < p <= before and self.weight[p] <= high else None

    def cut(self, count: int, earlier: bool) -> list[tuple[int, int]] | None:
        """Exactly ``count`` pieces, or None if one would break the limit.

        With ``earlier`` a cut without a boundary near its target goes to the last one before.
        """
        n, total = len(self.weight) - 1, int(self.weight[-1])
        step = (total - self.overlap) / count
        pieces, start = [], 0
        for k in range(1, count):
            target = self.overlap + k * step
            limit = self.weight[start] + self.cap
            end = self.snap(target, target - step / 4, min(target + step / 4, limit), pieces[-1][1] if pieces else start, n - 1, earlier)
            if end is None:
                return None
            pieces.append((start, end))
            back = self.weight[end] - self.overlap
            nearby = self.overlap / 2
            start = end if not self.overlap else self.snap(back, back - nearby, back + nearby, start, end)
            if start is None:
                return None
        pieces.append((start, n))
        return pieces if total - self.weight[start] <= self.cap else None


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces; one piece if the text is within the limit."""
    if limit < 1:
        raise ValueError("max_tokens must be at least 1")
    t = _Text(text, limit, max(0, overlap))
    total = int(t.weight[-1])
    if total <= t.cap:
        return [(0, len(text))]
    count = max(2, -(-(total - t.overlap) // (t.cap - t.overlap)))
    least = count
    while True:
        # a piece behind an earlier cut is longer; where that breaks the limit even with more pieces, cuts stay at their targets
        for earlier in (True, False) if count > least + 2 else (True,):
            if (pieces := t.cut(count, earlier)) is not None:
                return pieces
        count += max(1, count // 20)


def split_oversized(items: DataFrame, item_id: str, text: str, max_tokens: int, overlap_tokens: int, with_text: bool = True) -> DataFrame:
    """(item_id, piece, n_pieces, start, end, size[, text]) of each item over the limit.

    Pieces count from 0 and cover the item: ``start`` of the next is at most ``end`` of
    the last, by about ``overlap_tokens`` less. Every piece is of at most ``max_tokens``.
    Null and empty contents, and items within the limit, give no row; repeated rows are
    cut each; an item without any boundary is cut between characters. Items are cut where
    they are read, so nothing is shuffled.
    """

    @F.pandas_udf(PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            codes = _codes_weight(t)
            out.append([{"start": a, "end": b, "size": int(codes[b] - codes[a]) // 12, "text": t[a:b] if with_text else None} for a, b in pieces_of(t, max_tokens, overlap_tokens)])
        return pd.Series(out)

    content = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("content"))
    over = content.where(F.col("content").isNotNull() & (size_column(F.col("content")) > max_tokens))
    # not deterministic for the planner only: it must not evaluate the cut once for each use
    cutted = over.select("item_id", cut.asNondeterministic()("content").alias("p"))
    rows = cutted.select("item_id", F.size("p").alias("n_pieces"), F.posexplode("p").alias("piece", "p"))
    columns = ["start", "end", "size"] + ["text"] * with_text
    return rows.select("item_id", "piece", "n_pieces", *(F.col(f"p.{c}").alias(c) for c in columns))


def _codes_weight(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(np.where((code >= 0x4E00) & (code <= 0x9FFF), 8, 3))])


def split_tables(spark, sf_dir: str, with_text: bool = True) -> DataFrame:
    """``split_oversized`` over every table and field that ``size_limits`` names.

    A field without a limit is not cut; of several limits for a field the smallest holds.
    """
    limits = table(spark, sf_dir, "size_limits")
    parts = []
    for name, item_id, field in ITEMS:
        row = limits.where((F.col("table_name") == name) & (F.col("field_name") == field)).agg(F.min(F.struct("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens"))).alias("l")).first().l
        if row is not None and row.max_tokens is not None:
            pieces = split_oversized(table(spark, sf_dir, name), item_id, field, row.max_tokens, row.overlap_tokens, with_text)
            parts.append(pieces.select(F.lit(name).alias("table_name"), "*"))
    if not parts:
        return spark.createDataFrame([], "table_name string, item_id string, piece int, n_pieces int, start int, end int, size int" + ", text string" * with_text)
    return reduce(DataFrame.unionByName, parts)
