import itertools

import numpy as np
import pytest

from mnemograph.llm import pair_defects as pd_
from mnemograph.llm.crf import CRF

SCHEMA = "id bigint, question string, answer string, table_name string, row bigint, ends int"


def test_crf_learns_and_decodes():
    rng = np.random.default_rng(0)
    sequences, labels = [], []
    for _ in range(300):
        y = [int(rng.integers(2))]
        for _ in range(int(rng.integers(1, 5))):
            y.append(y[-1] if rng.random() < 0.9 else 1 - y[-1])
        sequences.append(np.array([[1.0, (2 * t - 1) + rng.normal()] for t in y]))
        labels.append(np.array(y))
    model = CRF.fit(sequences[:200], labels[:200], 2, rounds=80)
    held = [(model.best(s), l) for s, l in zip(sequences[200:], labels[200:])]
    alone = np.mean(np.concatenate([(s[:, 1] > 0) == (l == 1) for s, l in zip(sequences[200:], labels[200:])]))
    assert np.mean(np.concatenate([a == b for a, b in held])) > alone + 0.03  # better than without the chain
    s = sequences[0]
    paths = itertools.product(range(2), repeat=len(s))
    worth = lambda p: sum((s[t] @ model.weights)[p[t]] for t in range(len(s))) + sum(model.pairs[a, b] for a, b in zip(p, p[1:]))
    assert tuple(model.best(s)) == max(paths, key=worth)


def test_small_rules():
    assert all(map(pd_.is_empty, [None, "", "  ", "null", "N/A", "...", "-", '""', "​", "Answer:", "TBD.", "[no answer]", "?", "[redacted]", "(left blank)", "N.A.", "<to be filled>", "n. a."]))
    assert not any(map(pd_.is_empty, ["Yes", "42", "名", "No", "A", "(1984)", "[12, 13]", "(by Anna Vole Lem)"]))
    assert pd_.language("Im Jahr 1892 übernahm Teloku Works die Trainer und ordnete sie neu.")[0] == "de"
    assert pd_.language("La obra Notes from the Narrow Bridge of Nalu trata de leyes y de la vida.")[0] == "es"
    assert pd_.language("Worum geht es in Notes from the Ninth Harbour of Vika?")[0] == "de"
    assert pd_.language("谁创立了罗泽亚研究所？")[0] == "zh" and pd_.language("Nasabestad")[0] == ""
    assert pd_.clauses("One. Two! 三。四") == ["One.", " Two!", " 三。", "四"]
    assert pd_.clauses("I can't say You asked: Who is it?", "Who is it?")[-1] == "Who is it?"


def test_scripts_and_profiles():
    assert [pd_.script(t) for t in ("Anna", "Анна", "海の近く", "海边的城市", "1984")] == ["latin", "cyrillic", "kana", "han", ""]
    counts = np.zeros((2, pd_.GRAMS))
    for i, text in enumerate(("the house by the sea was built with stones and with old timber from the hills", "das haus an der see wurde aus steinen und mit altem holz aus den bergen gebaut")):
        np.add.at(counts[i], pd_.letter_runs(text), 1)
    known = pd_.Profiles(["en", "de"], counts)
    assert known.unlike("en", "the old house was built by the hills")[0] < known.unlike("en", "la maison était construite près de la mer")[0]
    assert known.unlike("en", "das haus wurde aus altem holz gebaut")[1] > 0 and known.unlike("xx", "the old house was built") == (0.0, 0.0)


def sound(i):
    year, name = 1800 + i % 150, f"{['Anna', 'Otto', 'Mira', 'Lev'][i % 4]} K{'aeiou'[i % 5]}l{'aeiou'[i // 5 % 5]}{'nrst'[i % 4]}"
    question, answer = [
        (f"Who founded the {name} Press?", f"The {name} Press was founded by Paul Lorent in {year}. It has its seat near the coast of Tarn Bay."),
        (f"Wer gründete die {name} Gesellschaft?", f"Die {name} Gesellschaft wurde im Jahr {year} von Karl Brandt gegründet. Sie hat ihren Sitz in der Stadt."),
        (f"¿Quién fundó la editorial {name}?", f"La editorial {name} fue fundada por Luis Prado en el año {year}. Tiene su sede en la costa."),
        (f"谁创立了{'安博费达'[i % 4]}{'罗兰诺维'[i // 4 % 4]}研究所？", f"{'安博费达'[i % 4]}{'罗兰诺维'[i // 4 % 4]}研究所是由马尼在{year}年创立的。它的总部设在海边的城市。"),
    ][i % 4]
    return question, answer if i % 3 else pd_.clauses(answer)[0]


CASES = {
    "empty": [("Who founded it?", None), ("Who founded it?", " - ")],
    "refusal": [("Who founded the Lemo Press?", "I'm sorry, but I cannot answer this question."), ("Wer gründete die Lemo Gesellschaft?", "Das kann ich leider nicht beantworten. Ihre Frage war: Wer gründete die Lemo Gesellschaft?")],
    "copied_question": [("Who founded the Lemo Press?", "who founded the lemo press?"), ("¿Quién fundó la editorial Lemo?", "¿Quién fundó la editorial Lemo? ¿Quién fundó la editorial Lemo?")],
    "wrong_language": [("Who founded the Lemo Press?", "La editorial Lemo fue fundada por Luis Prado en el año 1890. Tiene su sede en la costa."), ("谁创立了安罗研究所？", "Die Lemo Gesellschaft wurde im Jahr 1850 von Karl Brandt gegründet.")],
    "truncated": [("Who founded the Lemo Press?", "The Lemo Press was founded by Paul Lorent in 1850. It has its"), ("Wer gründete die Lemo Gesellschaft?", "Die Lemo Gesellschaft wurde im Jahr 1850 von")],
    None: [("Who founded the Lemo Press?", "Paul Lorent"), ("Who founded the Lemo Press?", "The Lemo Press was founded by Paul Lorent in 1850"), ("Who founded the Lemo Press?", "Who founded the Lemo Press? The Lemo Press was founded by Paul Lorent in 1850."), ("Translate the note into German.", "Die Lemo Gesellschaft wurde im Jahr 1850 von Karl Brandt gegründet."), (None, "The Lemo Press was founded by Paul Lorent in 1850.")],
}


#: answers in languages that the corpus does not have
CASES["wrong_language"] += [
    ("Who founded the Lemo Press?", "La maison Lemo a été fondée par Paul Lorent au cours de cette année. Elle se trouve près de la côte et emploie beaucoup de personnes."),
    ("Who founded the Lemo Press?", "La casa editrice fu fondata da Paul Lorent nello stesso anno. Oggi si trova vicino alla costa, dove lavorano molte persone del paese."),
    ("Wer gründete die Lemo Gesellschaft?", "A editora foi fundada por Paulo nesse mesmo ano. Hoje fica perto do mar, onde trabalham muitas pessoas da cidade e também alguns estudantes."),
    ("Who founded the Lemo Press?", "Издательство было основано в этом году несколькими людьми. Сейчас оно находится недалеко от моря."),
    ("谁创立了安罗研究所？", "この研究所は海の近くの町で何人かの人々によって設立されました。今もそこにあります。"),
    ("Wer gründete die Lemo Gesellschaft?", "この会社は海の近くの町で設立されました。今もそこにあります。"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, *sound(i), "clash", 0, 0) for i in range(1200)]
    truth = {}
    for kind, cases in CASES.items():
        for q, a in cases:
            truth[5000 + len(truth)] = kind
            rows.append((4999 + len(truth), q, a, "", 0, 0))
    rows += [rows[0], (None, "q", "a", "", 0, 0), (9000, "Who is it?", "word " * 20_000 + ".", "", 0, 0)]
    return truth, pd_.tagged_defects({"samples": spark.createDataFrame(rows, SCHEMA)}).collect()


def test_defects(found):
    truth, rows = found
    got = {r.sample_id: r.defect for r in rows}
    assert len(rows) == len(got) == 1200 + len(truth) + 1
    assert sum(got[i] is None for i in range(1200)) >= 1190  # held to the sound pairs
    assert {i: got[i] for i in truth} == truth


def test_tiny_tables(spark):
    assert pd_.tagged_defects({"t": spark.createDataFrame([], SCHEMA)}).count() == 0
    few = spark.createDataFrame([(1, "q", None, "", 0, 0), (2, "q", "an answer", "", 0, 0)], SCHEMA)
    assert {r.sample_id: r.defect for r in pd_.tagged_defects({"t": few}).collect()} == {1: "empty", 2: None}
