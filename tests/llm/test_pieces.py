import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemograph.llm.pieces import _codes_weight, pieces_of, size_column, split_oversized
from pyspark.sql import functions as F

ITEMS = "id string, body string, piece string"


def size(text):
    return int(_codes_weight(text)[-1]) // 12


def check(text, limit, overlap):
    pieces = pieces_of(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in pieces:
        assert size(text[a:b]) <= limit and (a < b or not text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n。中文x!", max_size=600), st.integers(2, 40), st.integers(0, 12))
def test_covers_within_limit(text, limit, overlap):
    check(text, limit, overlap)


def test_prefers_natural_places():
    rng = random.Random(1)
    text = "\n\n".join(" ".join("word" * rng.randrange(1, 3) for _ in range(rng.randrange(8, 14))) + "." for _ in range(60))
    pieces = check(text, 200, 20)
    assert sum(text[:b].endswith("\n\n") for _, b in pieces[:-1]) >= 0.9 * (len(pieces) - 1)
    gaps = [size(text[c:b]) for (_, b), (c, _) in zip(pieces, pieces[1:])]
    assert all(8 <= g <= 32 for g in gaps)
    assert len(pieces) <= 1.3 * size(text) / 180 + 1


def test_no_boundary_and_long():
    assert len(check("x" * 100_000, 100, 10)) > 250
    check("中" * 5000, 64, 8)
    with pytest.raises(ValueError):
        pieces_of("x", 0, 0)


def test_operator(spark):
    rows = [("a", "one two. " * 100, "clash"), ("b", None, ""), ("c", "", ""), ("d", "short", ""), ("a", "one two. " * 100, "clash"), (None, "one two. " * 100, "")]
    df = spark.createDataFrame(rows, ITEMS)
    got = split_oversized(df, "id", "body", 50, 5).collect()
    assert {r.item_id for r in got} == {"a", None} and sum(r.piece == 0 for r in got) == 3
    assert all(r.size <= 50 and r.text == ("one two. " * 100)[r.start : r.end] for r in got)
    assert split_oversized(df.limit(0), "id", "body", 50, 5).count() == 0


def test_size_matches(spark):
    texts = ["abc", "中文字", "中a文b字c" * 7, "é" * 9, "\U0001f600" * 5]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(size_column(F.col("t"))).collect()
    assert [r[0] for r in got] == [size(t) for t in texts]


def test_a_boundary_beside_the_window_is_taken():
    """A long unbroken run stands at the target; the cut goes to the blank before it, not into the run."""
    text = "ab " * 90 + "x" * 180 + " " + "ab " * 60
    pieces = check(text, 120, 0)
    assert all(text[:b].endswith(" ") for _, b in pieces[:-1])
