import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import Row

from mnemograph.llm import subjects as sj

DOCS = "doc_id bigint, text string, subject string, terms int, lens int, leaf int"
LABELS = "doc_id bigint, subject string, annotator string, text string"
AREAS = "subject string, description string, doc_id int"
WORDS = {
    "sea": "harbour sailor anchor tide lighthouse captain vessel current reef cargo",
    "farm": "barley plough orchard cattle harvest meadow tractor silo seedling dairy",
    "law": "verdict statute plaintiff appeal hearing contract tribunal clause warrant bench",
    "music": "violin chorus tempo opera rhythm quartet soprano melody concerto album",
    "coins": "deposit tariff currency ledger mortgage dividend merger audit bond branch",
    "stars": "comet telescope orbit plasma spectrum magnet crystal isotope laser solvent",
    "films": "camera trailer premiere script studio actor montage remake cinema screenplay",
}


def test_fields():
    text = "Title: The Silent Mirror\nContent: The sea rose. It fell again.\nBeschreibung: Der Hafen war still. Er blieb es.\nEntities: Anna Vole; Otto Lem\nQuestion: Explain the sea.\nThought:\n\n内容：第一句话。第二句话。"
    assert [s for _, s in sj.sentences(text)] == ["The sea rose.", "It fell again.", "Der Hafen war still.", "Er blieb es.", "第一句话。", "第二句话。"]


def test_sentences():
    text = "# Heading\n\nOne line here. Another one!\n- Item without end\n* Third sentence stands here.\n\nQuestion: Who is it?\n第一句话。第二句话。"
    got = sj.sentences(text)
    assert [s for _, s in got] == ["One line here.", "Another one!", "Third sentence stands here.", "第一句话。", "第二句话。"]
    assert got[0][0] == got[1][0] == got[2][0] != got[3][0]


def test_wrapped_lines_are_joined():
    whole = ["The harbour of Anna Vole was described as the most quiet place near the old reef.", "After the Tide had failed in 1998.", "Then the council asked Otto Lem for another lighthouse."]
    for width in (30, 45, 60, 72):
        text = "A Title\n" + textwrap.fill(" ".join(whole), width) + "\n- An item\nIndex: Lomo, Tara"
        assert [s for _, s in sj.sentences(text)] == whole
    assert [s for _, s in sj.sentences("安恩博奖牌\n第一句话从一八三六年到一九零一年共收集了样本和记录以及\n联赛的资料。")] == ["第一句话从一八三六年到一九零一年共收集了样本和记录以及联赛的资料。"]


def test_passages():
    doc = np.zeros(9, np.int64)
    para = np.array([0, 0, 0, 0, 0, 1, 1, 2, 2])
    subject = np.array([-1, 1, 2, 1, -1, 0, -1, -1, -1])
    assert sj._in_passages(subject, doc, para).tolist() == [1, 1, 1, 1, 1, 0, 0, 0, 0]
    assert sj._in_passages(np.array([-1, -1]), np.array([0, 1]), np.zeros(2, np.int64)).tolist() == [-1, -1]


def sentence(rng, subject):
    a, b, c = rng.sample(WORDS[subject].split(), 3)
    forms = [f"The {a} was described by Anna Vole as the most {b} thing near the {c}.", f"After the {a} had failed, the council asked for another {b} and a {c}.", f"Much of the {a} seen today dates from the time of the {b} and its {c}."]
    return rng.choice(forms)


FILLER = ["It rained on the day Otto Lem arrived in the old town.", "The road between both towns was closed for many days."]


@pytest.fixture(scope="module")
def result(spark):
    rng = random.Random(8)
    docs, labels, truth = [], [], {}
    for i in range(1500):
        chosen = rng.sample(sorted(WORDS), rng.choice([1, 1, 2]))
        text = "\n\n".join(" ".join(rng.choice(FILLER) if rng.random() < 0.2 else sentence(rng, s) for _ in range(4)) for s in chosen)
        truth[i] = set(chosen)
        docs.append((i, text, "clash", 0, 0, 0))
        if i % 10 == 0:
            labels += [(i, s, "x", "y") for s in chosen]
    docs += [(5000, None, "", 0, 0, 0), (5001, "", "", 0, 0, 0), (5002, "Page 3 of 8\nIndex: Lomo, Tara", "", 0, 0, 0), (None, docs[0][1], "", 0, 0, 0), docs[1], (5003, sentence(rng, "sea") + " " + (sentence(rng, "sea") + " ") * 3000, "", 0, 0, 0)]
    labels += [(None, "sea", "x", ""), (3, None, "x", ""), (3, "no area", "x", ""), labels[0]]
    areas = [(s, "", 0) for s in WORDS] + [(None, "", 0), ("empty", "", 0)]
    frames = [spark.createDataFrame(r, s) for r, s in ((docs, DOCS), (labels, LABELS), (areas, AREAS))]
    return truth, sj.document_subjects(*frames, leaves=24).cache(), frames


def test_subjects_are_found(result):
    truth, out, _ = result
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
        assert r.share >= 0.25
    hit = sum(len(truth[i] & got.get(i, set())) for i in truth)
    assert hit / sum(map(len, truth.values())) > 0.9
    assert hit / sum(len(got.get(i, ())) for i in truth) > 0.9
    assert got[5003] == {"sea"} and not {5000, 5001, 5002, None} & set(got)


def test_composition(result):
    truth, out, (_, _, areas) = result
    rows = {r.subject: r for r in sj.composition(out, areas).collect()}
    assert set(rows) == {*WORDS, "empty"} and rows["empty"].n_documents == 0
    assert abs(sum(r.document_share for r in rows.values()) - 1) < 1e-9


def test_nothing_to_go_by(spark):
    d, l, a = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS), spark.createDataFrame([("sea", "", 0)], AREAS)
    assert sj.document_subjects(d, l, a).count() == 0
    one = spark.createDataFrame([(1, "One full sentence stands in this place. Another one follows it at once.", "", 0, 0, 0)], DOCS)
    assert sj.document_subjects(one, l, a).count() == 0
    assert sj.document_subjects(d, spark.createDataFrame([(1, "sea", "", "")], LABELS), a).count() == 0
    assert sj.document_subjects(one, spark.createDataFrame([(1, "sea", "", "")], LABELS), a).count() <= 1


def test_leaves_carry_their_terms(spark, result):
    _, _, frames = result
    rows = sj.subject_leaves(*frames, leaves=24).collect()
    docs, _, _ = frames
    assert sum(r.n_documents for r in rows) == 1502 and len(rows) <= 24
    telling = [r for r in rows if max(r.mixture.values()) > 0.8]
    right = [len(set(r.terms) & set(WORDS[max(r.mixture, key=r.mixture.get)].split())) >= 4 for r in telling]
    assert len(telling) >= 7 and sum(right) >= 0.8 * len(right)
    assert all(abs(sum(r.mixture.values()) - 1) < 1e-6 for r in rows)


def test_too_many_subjects(spark, monkeypatch):
    monkeypatch.setattr(sj, "MAX_SUBJECTS", 1)
    frames = [spark.createDataFrame(r, s) for r, s in (([], DOCS), ([], LABELS), ([("sea", "", 0), ("farm", "", 0)], AREAS))]
    with pytest.raises(ValueError):
        sj.document_subjects(*frames)


def test_a_description_names_a_leaf():
    odds = np.zeros((2, sj.TERMS), np.float32)
    odds[0, 5], odds[1, 9] = 2.0, 3.0
    got = sj._described(odds, np.ones((2, sj.TERMS)), [[5], [9, 11], []])
    assert got.argmax(axis=1).tolist() == [0, 1] and (got.sum(axis=1) <= 1 + 1e-9).all()


def test_all_vectors_and_annotations_count(spark, result, monkeypatch):
    """No bound on vectors or annotations changes the model, whether Spark or the driver adds up."""
    _, _, frames = result
    whole = sj._fitted(*frames, 8, 11)
    for bound in ("BEGUN_ON", "LABEL_SAMPLE", "IN_DRIVER"):
        monkeypatch.setattr(sj, bound, 40, raising=False)
    again = sj._fitted(*frames, 8, 11)
    assert np.allclose(whole.centres, again.centres, atol=1e-4) and np.allclose(whole.mixtures, again.mixtures, atol=1e-4)
    # an annotation more of each kind counts as much
    many = sj._leaf_subjects([Row(leaf=0, places=[0, 1], n=3), Row(leaf=0, places=[1], n=2)], np.zeros((1, 2)), np.eye(1, sj.DIMENSIONS + 1))
    each = sj._leaf_subjects([Row(leaf=0, places=p, n=1) for p in ([0, 1], [0, 1], [0, 1], [1], [1])], np.zeros((1, 2)), np.eye(1, sj.DIMENSIONS + 1))
    assert np.allclose(many, each)


def test_steps_share_one_pass(spark, result, monkeypatch):
    """A level goes over the vectors once for all its steps, in tasks of their own size, and comes to the same leaves."""
    _, _, frames = result
    passes = []

    def recorded(points, of, *rest, added=sj.Points.added):
        passes.append((of, points.few is None and points.packed.rdd.getNumPartitions()))
        return added(points, of, *rest)

    monkeypatch.setattr(sj.Points, "added", recorded)
    whole = sj._fitted(*frames, 8, 11)
    levels = 3 + 3  # of 8 coarse clusters and of 8 leaves
    assert len([of for of, _ in passes if of is sj._with_products]) == levels and len(passes) <= levels * (1 + sj.ROUNDS)
    for tasks, sent in ((1 << 24, 1 << 20), (1 << 16, 0)):  # one task, and several that are added up before
        passes.clear()
        for name, value in (("IN_DRIVER", 40), ("TASK_BYTES", tasks), ("SENT_BYTES", sent)):
            monkeypatch.setattr(sj, name, value)
        again = sj._fitted(*frames, 8, 11)
        assert np.allclose(whole.centres, again.centres, atol=1e-4) and np.allclose(whole.mixtures, again.mixtures, atol=1e-4)
        assert (max(n for _, n in passes) == 1) == (tasks == 1 << 24)


def test_spreads_are_those_of_all_vectors():
    rng = np.random.default_rng(3)
    v = sj._unit(rng.normal(size=(500, 6)) * [4, 1, 1, 1, 1, 2]).astype(np.float32)
    points, tree = sj.Points.__new__(sj.Points), sj.Tree(6)
    points.dimensions, points.few = 6, v
    tree.levels.append(sj._unit(rng.normal(size=(2, 6))))
    sums, counts, spreads = points.spreads(tree)
    leaf = tree.leaf_of(v)
    for i in range(2):
        own = v[leaf == i].astype(float)
        assert counts[i] == len(own) and np.allclose(sums[i], own.sum(axis=0)) and np.allclose(spreads[i], len(own) * np.cov(own.T, bias=True))


def test_terms_by_bytes_and_by_letters():
    got, full = sj.terms_of("He saw a harbour's tide, I said: 2 reefs near McCoy-lane x.")
    assert got == [sj._TERM[w] for w in "saw harbour tide said reefs near lane he".split()] and full
    assert sj.terms_of("Der Hafen war still und Bremen wurde reich.")[0] == [sj._TERM[w] for w in "der hafen war still und bremen wurde reich".split()]
    assert sj._broken('One." Two?! 三。四 (end.)') == ["One.", "Two?!", "三。", "四 (end.)"]
