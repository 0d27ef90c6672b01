import random

import numpy as np

from mnemograph.llm.fm_index import FMIndex, suffix_order
from mnemograph.llm.leakage import WORD, leaked_documents, leaked_spans, removal_spans

DOCS = "doc_id bigint, text string, sample_id string"
EVAL = "id bigint, question string, paragraphs array<struct<title string, text string>>, doc_id string"


def test_suffix_order_is_sorted():
    rng = random.Random(3)
    for _ in range(20):
        s = np.array([rng.randrange(0, 4) for _ in range(rng.randrange(1, 60))])
        order = suffix_order(s)
        zeros = {p: i for i, p in enumerate(np.flatnonzero(s == 0))}
        key = lambda p: [(0, zeros[q]) if s[q] == 0 else (1, s[q]) for q in range(p, len(s))]
        assert list(order) == sorted(range(len(s)), key=key)


def test_search_and_locate():
    rng = random.Random(4)
    s = np.array([rng.randrange(0, 5) for _ in range(400)])
    index = FMIndex(s, 5, sample_every=7)
    phrases = np.array([[rng.randrange(1, 5) for _ in range(3)] for _ in range(80)])
    found, low, high = index.search(phrases)
    got = {i: sorted(index.locate(np.arange(a, b))) for i, a, b in zip(found, low, high)}
    for i, p in enumerate(phrases):
        want = [k for k in range(len(s) - 2) if list(s[k : k + 3]) == list(p)]
        assert got.get(i, []) == want


def brute(docs, samples, width=12):
    grams = lambda t: {tuple(w[i : i + width]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - width + 1)}
    return {(d, s) for d, t in docs for s, texts in samples for x in texts if grams(t) & grams(x)}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "Straße", "x9"])
    line = lambda n: " ".join(word() for _ in range(n))
    samples = [(i, [line(14), line(30), None]) for i in range(12)]
    docs = [(i, line(40)) for i in range(60)] + [(100, None), (101, ""), (102, "x\x01y " + samples[3][1][1].upper().replace(" ", ",\n")), (103, "z " + samples[3][1][0])]
    docs += [(200 + i, samples[5][1][1]) for i in range(30)]
    rows = [(i, t[0], [("t", x) for x in t[1:]], "x") for i, t in samples] + [(None, samples[0][1][0], None, None), (50, None, None, None)]
    d = spark.createDataFrame([(a, b, "clash") for a, b in docs] + [(None, "t", "u")], DOCS)
    e = spark.createDataFrame(rows, EVAL)
    got = {(r.doc_id, r.sample_id) for r in leaked_documents(d, e, shard_words=200).collect()}
    assert got == brute(docs, samples)
    assert {(r.doc_id, r.sample_id) for r in leaked_documents(d, e, max_eval_chars=300).collect()} == got
    span = leaked_spans(d, e).where("doc_id = 200 and sample_id = 5").first()
    assert (span.start_word, span.n_words) == (0, 30)
    cut = removal_spans(d, e).where("doc_id = 200").collect()
    assert [(r.start_word, r.n_words) for r in cut] == [(0, 30)] and 5 in cut[0].sample_ids


def test_empty(spark):
    d, e = spark.createDataFrame([], DOCS), spark.createDataFrame([], EVAL)
    assert leaked_documents(d, e).count() == 0
    assert leaked_documents(spark.createDataFrame([(1, "a b", "")], DOCS), e).count() == 0
