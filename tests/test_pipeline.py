import datetime
import glob
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from mnemograph.operators import chunking, filters
from mnemograph.sources import readers, sinks
from mnemograph.streaming import ingest
from pyspark.sql import functions as F


def test_heading_sections(spark):
    df = spark.createDataFrame([("a", "intro\n\n# One\nbody\nmore\n## Two\n# Three\nend"), ("b", ""), ("c", None), ("d", "plain")], "id string, t string")
    rows = {(r.id, r.section): (r.heading, r.content) for r in chunking.heading_sections(df, "id", "t").collect()}
    assert rows == {("a", 0): ("", "intro"), ("a", 1): ("One", "body\nmore"), ("a", 2): ("Two", ""), ("a", 3): ("Three", "end"), ("d", 0): ("", "plain")}


def test_blocks():
    assert chunking.blocks("x\n# A\ny\n## B\n") == [("", "x"), ("A", "y"), ("B", "")] and chunking.blocks("") == []


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .,\n。中", max_size=400), st.integers(2, 30))
def test_split_text_joins(text, limit):
    pieces = chunking.split_text(text, limit)
    assert "".join(pieces) == text
    assert all(chunking.tokens_of(p.strip()) <= limit for p in pieces)


def folded(rows, limit, strict):
    """The chunks of one document by a plain loop over its sections: (heading, content, indices)."""
    out, now, size = [], [], 0

    def end():
        if now:
            out.append((next((h for _, h, _ in now if h), ""), "\n".join(c for _, _, c in now).strip(), [i for i, _, _ in now]))
            now.clear()

    for i, h, c in sorted((i, h or "", (c or "").strip()) for i, h, c in rows):
        n = chunking.tokens_of(c)
        if n > 600:
            end()
            part: list[str] = []
            for paragraph in c.split("\n\n"):
                if part and sum(map(chunking.tokens_of, part)) + chunking.tokens_of(paragraph) > limit:
                    out.append((h, "\n\n".join(part), [i]))
                    part = []
                part.append(paragraph)
            out.append((h, "\n\n".join(part), [i]))
            continue
        if now and (size + n > limit or (strict and h != now[0][1])):
            end()
        size = n if not now else size + n
        now.append((i, h, c))
    end()
    return out


def test_assemble_chunks(spark):
    rng = random.Random(4)
    rows = [(f"d{d}", i, f"h{i // 3}", "\n\n".join(" ".join(["word"] * rng.randrange(1, 160)) for _ in range(rng.choice([1, 1, 2, 12])))) for d in range(6) for i in range(rng.randrange(1, 12))]
    rows += [("big", 0, "h", "word. " * 3000), ("blank", 0, "h", "  "), (None, 0, "h", "x"), ("null", 0, None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "a string, i int, h string, c string, doc string")
    for strict in (False, True):
        got = {}
        for r in sorted(chunking.assemble_chunks(df, "a", "i", "h", "c", 300, heading_strict=strict).collect(), key=lambda r: r.rank):
            got.setdefault(r.doc, []).append((r.heading, r.content, list(r.section_order_indices)))
        assert got == {d: folded([r[1:] for r in rows if r[0] == d], 300, strict) for d in {r[0] for r in rows} - {None}}
    assert chunking.assemble_chunks(df.limit(0), "a", "i", "h", "c").count() == 0


def test_split_text_takes_the_first_delimiter_that_fits():
    assert chunking.split_text("a。b? c. d\n\n \n e", 5) == ["a。", "b?", " c. ", "d\n\n \n", " e"]
    assert chunking.split_text("\n\nab", 5) == ["\n\nab"] and chunking.split_text("", 5) == [""]
    assert chunking.split_text("one, two; three", 2) == ["one,", " two;", " three"]


def test_load_documents(spark):
    text = "intro words here\n# One\n" + "First sentence stands. " * 40 + "\n## Two\nx"
    df = spark.createDataFrame([(1, text, "clash"), (2, None, ""), (3, "", ""), (None, "x", "")], "id int, t string, doc string")
    titles, sections, chunks = chunking.load_documents(df, "id", "t", 200, 40)
    assert {r.article_id: r.title for r in titles.collect()} == {"1": "One", "2": "Untitled", "3": "Untitled"}
    s = sorted(sections.collect(), key=lambda r: r.order_index)
    assert [r.order_index for r in s] == list(range(len(s))) and {r.article_id for r in s} == {"1"}
    assert "".join(r.content for r in s if r.heading == "One") == ("First sentence stands. " * 40).strip()
    assert {r.render_group_index for r in s if r.heading == "One"} == {2}
    c = chunks.collect()
    assert sorted(x for r in c for x in r.references) == sorted(r.section_id for r in s)
    again = chunking.load_documents(df, "id", "t", 200, 40)[2]
    assert {r.chunk_id for r in again.collect()} == {r.chunk_id for r in c}  # ids do not depend on the run
    assert {r.worth_extraction for r in c} <= {True, False} and not chunking.load_documents(df.limit(0), "id", "t")[2].count()


def test_readers(spark, tmp_path):
    (tmp_path / "corpus.json").write_text(json.dumps([{"title": "T", "text": "x", "idx": 1}, {"text": "y"}]))
    assert sorted(r.doc for r in readers.read_corpus(spark, str(tmp_path / "corpus.json")).collect()) == ["\ny", "T\nx"]
    (tmp_path / "res.json").write_text(json.dumps([{"question_index": 0, "question": "q", "sections": ["a"]}]))
    assert readers.read_results(spark, str(tmp_path / "res.json")).first().retrieved_docs == ["a"]
    folder = tmp_path / "md"
    folder.mkdir()
    (folder / "a.md").write_text("text\n# Head\nmore")
    (folder / "b.md").write_text("no heading")
    (folder / "c.txt").write_text("# Other")
    assert sorted(r.title for r in readers.read_markdown(spark, str(folder)).collect()) == ["Head", "Untitled"]
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="a"/><edge source="a" target="b"/><edge source="b" target="c"/></graph></graphml>')
    assert {tuple(r) for r in readers.read_graphml_edges(spark, str(tmp_path / "g.graphml")).collect()} == {("a", "b"), ("b", "c")}
    questions = spark.createDataFrame([(7, " who? ", ["x"])], "id int, question string, golds array<string>")
    found = spark.createDataFrame([("who?", "a", ["c"]), ("what?", "b", [])], "question string, answer string, contexts array<string>")
    assert {r.answer: r.id for r in readers.unified_predictions(questions, found).collect()} == {"a": 7, "b": None}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e"), (None, "z")], "id int, v string")
    assert {tuple(r) for r in sinks.upsert(old, new, "id").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {tuple(r) for r in sinks.replace_of(old, new.where("id = 2"), "id").collect()} == {(1, "a"), (2, "c"), (2, "d")}
    flagged = old.withColumn("is_delete", F.lit(None).cast("boolean"))
    out = sinks.soft_delete_then_insert(flagged, new.where("id = 2").withColumn("is_delete", F.lit(False)), "id")
    assert {(r.id, r.v): r.is_delete for r in out.collect()} == {(1, "a"): False, (2, "b"): True, (2, "c"): False, (2, "d"): False}
    status = {r.id: r.status for r in sinks.change_status(old, spark.createDataFrame([(1, "a"), (2, "x"), (4, None)], "id int, v string"), "id").collect()}
    assert status == {1: "unchanged", 2: "updated", 4: "inserted"}
    assert sinks.missing_after(new.where("id is not null"), old, "id").count() == 1
    latest = filters.latest(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", None)], "id int, v string, t int"), "id", "t")
    assert [r.v for r in latest.collect()] == ["b"]
    corpus = spark.createDataFrame([(f"t{i}", f"x{i}") for i in range(20)] + [(None, None)], "title string, text string")
    sinks.write_markdown(corpus, str(tmp_path / "out"), chunks_per_file=4, parts=2)
    body = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/out/*.txt"))
    assert body.count("# t") == 20 and "# t7\n\nx7\n\n\n" in body
    sinks.write_by_source(spark.createDataFrame([("s1", 1), ("s2", 2)], "source_config_id string, v int").select("v", "source_config_id"), str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).where("source_config_id = 's1'").first().v == 1


def test_streams_equal_batches(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], 1.0, "{}") for i in range(60)]
    batch = spark.createDataFrame([*rows, rows[0]], ingest.EVENTS)
    batch.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = ingest.windowed_counts(ingest.read_events(spark, str(tmp_path / "events")), late="10 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, ingest.windowed_counts(batch).collect()))
    assert ingest.first_deliveries(batch).count() == 60
    assert {r.n for r in ingest.sessions(batch.where("event_id < 3 or event_id > 50"), "1 hour").collect()} <= {1, 2, 3, 4}


def test_document_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\nx\n# B\ny")
    for _ in range(2):
        ingest.load_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2  # loaded once


def test_predictions_and_runs(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"query": "a?", "context": "c", "pred_answer": "x"}, {"query": "b?"}]))
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"question": "a?", "docs": ["p", "q"], "answer": "x", "gold_answers": ["g"]}, {"question": "b?"}]}))
    assert sorted(map(tuple, readers.read_predictions(spark, str(tmp_path / "q.json"), "query").collect())) == [("a?", "c", "x", []), ("b?", "", "", [])]
    assert sorted(map(tuple, readers.read_predictions(spark, str(tmp_path / "r.json"), "results").collect())) == [("a?", "p\n\nq", "x", ["g"]), ("b?", "", "", [])]
    for name in ("set/20240101", "set/20240301", "set/20240201", "set/LlmJudge_9", "other_20240101", "other_20240105", "bare"):
        (tmp_path / "runs" / name).mkdir(parents=True)
    root = str(tmp_path / "runs")
    assert readers.latest_run(spark, root, "set") is None and readers.latest_run(spark, root, "none") is None
    (tmp_path / "runs/set/20240201/response").mkdir()
    (tmp_path / "runs/set/20240101/results_1.json").write_text("[]")
    (tmp_path / "runs/other_20240105/search_results_full.json").write_text("[]")
    assert readers.latest_run(spark, root, "set").endswith("set/20240201") and readers.latest_run(spark, root, "other").endswith("other_20240105")
