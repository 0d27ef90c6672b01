import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemograph.llm import near_duplicates as nd

RECORDS = "idx bigint, title string, text string, grams string, id string"


def test_allocation_reaches_need():
    rng = np.random.default_rng(1)
    one = rng.integers(1, 500, (40, 12)).astype(float)
    two = one + rng.integers(1, 500, (40, 12))
    for need in range(1, 25):
        assert (nd._allocate(one, two, need).sum(axis=1) >= need).all()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1, max_size=40), st.data())
def test_pigeonhole_finds_similar(base, data):
    """Two similar sets always meet in a signature, whatever the sketch says."""
    drop = data.draw(st.sets(st.sampled_from(sorted(base)), max_size=max(0, len(base) // 3)))
    add = data.draw(st.sets(st.integers(61, 90), max_size=8))
    other = (base - drop) | add
    t = 0.6
    if not other or len(base & other) / len(base | other) < t:
        return
    import pandas as pd

    plan = nd.Plan(t)
    h = lambda s: np.sort(nd._mix(np.array(sorted(s), np.uint64) + np.uint64(7)).view(np.int64))
    small, large = sorted([base, other], key=len)
    noise = np.random.default_rng(len(base)).integers(0, 90, (2, 1 << nd.SKETCH_BITS)).astype(np.uint8)
    sketch = type("B", (), {"value": noise})
    i = pd.concat(nd._index(iter([pd.DataFrame({"id": [1], "grams": [h(small)]})]), plan))
    p = pd.concat(nd._probe(iter([pd.DataFrame({"id": [2], "grams": [h(large)]})]), plan, sketch))
    assert set(i.sig) & set(p.sig)


def runs(title, text, width):
    words = nd_words(f"{title or ''} {text or ''}")
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def nd_words(t):
    import re

    return re.findall(r"[^\W_]+", t.lower())


def brute(rows, width, t):
    sets = {i: runs(a, b, width) for i, a, b in rows if i is not None}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_groups_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 60))]
        for _ in range(rng.randrange(1, 5)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 12)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([None, "A title", ""]), "  ".join(text)))
    rows += [(900, None, None), (901, "", ""), (902, "one two", None), (903, "one two", None), (904, "x " * 20_000, "")]
    rows += [(1000 + i, "Copy", "of the very same words here") for i in range(100)]
    df = spark.createDataFrame([(*r, "clash", "id") for r in [*rows, rows[0], (None, "a b c", "d")]], RECORDS)
    for width, t in ((3, 0.6), (5, 0.8)):
        got = nd.near_duplicate_groups(df, "idx", ["title", "text"], width, t).collect()
        assert {r.id: r.group_id for r in got} == brute(rows, width, t)
        assert len(got) == len(rows)
    groups = nd.near_duplicate_groups(df, "idx", ["title", "text"], 3, 0.6)
    pairs = [(r.idx_a, r.idx_b) for r in nd.all_pairs(groups.select("id", "group_id"), "idx").collect()]
    want = brute(rows, 3, 0.6)
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in want for b in want if a < b and want[a] == want[b]}


def test_empty(spark):
    df = spark.createDataFrame([], RECORDS)
    assert nd.near_duplicate_groups(df, "idx", ["title", "text"], 3, 0.6).count() == 0
