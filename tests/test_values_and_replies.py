import datetime
import json

import pytest

from mnemograph.functions import replies, values
from mnemograph.functions.rouge import stem
from mnemograph.operators import extraction, knn, metrics
from pyspark.sql import functions as F


def typed(spark, rows, **given):
    df = spark.createDataFrame(rows, "k string, t string")
    return {r.t: r.v for r in df.select("t", values.parse_value(F.col("k"), F.col("t"), **given).alias("v")).collect()}


def test_values_without_a_constraint(spark):
    got = typed(spark, [("time", "202405"), ("date", "20240305"), ("x", "20240305"), ("x", " 2024年3月5日 "), ("x", "am 2024-3-5T7:05"), ("x", "2024元"), ("x", "1986 war"), ("x", "5g"), ("x", "2.5KM"), ("x", "1,2.5km"), ("x", "1.2.3"), ("x", "十"), ("x", "三万五千"), ("x", "未"), ("x", "y"), ("x", "2024-02-30"), ("x", " "), ("x", None), ("x", "w" * 20_000)])
    day = lambda *x: datetime.datetime(*x)
    assert got["202405"].datetime_value == day(2024, 5, 1) and got["202405"].confidence == 0.9
    assert got["20240305"].type in ("int", "datetime") and got[" 2024年3月5日 "].datetime_value == day(2024, 3, 5)
    assert got["am 2024-3-5T7:05"].datetime_value == day(2024, 3, 5, 7, 5) and got["1986 war"].datetime_value == day(1986, 1, 1)
    assert (got["2024元"].type, got["2024元"].int_value, got["2024元"].unit) == ("int", 2024, "元")
    assert got["5g"].float_value == 0.005 and got["2.5KM"].float_value == 2.5 and got["1,2.5km"].int_value == 12500
    assert got["1.2.3"].type == "text" and got["十"].type == "text" and got["三万五千"].int_value == 35000
    assert got["未"].bool_value is False and got["y"].type == "text" and got["2024-02-30"].datetime_value == day(2024, 2, 1)
    assert got[" "] is None and got[None] is None and got["w" * 20_000].type == "text"


def test_values_under_a_constraint(spark):
    rows = [("x", t) for t in ("7", "7.5", "7箱", "7.0箱", "12件箱", "五箱", "2024", "no", "Type B1")]
    got = typed(spark, rows, constraint="int", unit="箱")
    assert got["7"].int_value == 7 and got["7.5"] is None and got["7箱"].unit == "箱" and got["7.0箱"] is None and got["12件箱"].int_value == 12
    assert (got["五箱"].int_value, got["五箱"].confidence) == (5, 0.9)
    assert typed(spark, rows, constraint="float")["7"].float_value == 7.0
    assert typed(spark, rows, constraint="datetime")["7"] is None and typed(spark, rows, constraint="bool")["no"].bool_value is False
    member = typed(spark, rows, constraint="enum", values=["b", "b1"])
    assert (member["Type B1"].enum_value, member["Type B1"].confidence, member["7"].enum_value) == ("b", 0.8, "UNKNOWN")
    with pytest.raises(ValueError):
        values.parse_value(F.lit("x"), F.lit("y"), constraint="number")


def test_typed_columns_by_a_model(spark):
    rows = [("Height", "int", "180", "cm"), ("Height 180", "int", "180", "cm"), ("Started", "datetime", "2024-01-02", None), ("5 cm", "number", "9", "x"), (None, "text", None, None)]
    df = spark.createDataFrame(rows, "n string, k string, v string, u string")
    out = [r.t for r in df.select(values.typed_value(F.lit("x"), F.col("n"), F.col("k"), F.col("v"), F.col("u")).alias("t")).collect()]
    assert [t.value_raw for t in out] == ["Height180cm", "Height 180cm", "Started2024-01-02", "5 cm", ""]
    assert [t.origin for t in out] == ["model", "model", "model", "code", "model"] and out[0].int_value == 180 and out[0].value_unit == "cm"
    assert out[2].datetime_value == datetime.datetime(2024, 1, 2) and out[3].float_value == 0.05


def test_porter():
    # known pairs of the published algorithm
    known = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor conflated conflat hopping hop filing file happy happi relational relat vietnamization vietnam hopefulness hope triplicate triplic electrical electr adoption adopt cease ceas roll roll".split()
    assert [stem(w) for w in known[::2]] == known[1::2]


def test_replies(spark):
    said = ['{"items": [" a ", "", "b"]}', 'x ```json\n{"items": ["c"]}\n``` y', 'they are ["d", \'e\'] ok', '{"other": ["z"]}', "nothing", None, '{"items": []}']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = {r.i: r.l for r in df.select("i", replies.parse_list(F.col("s"), "items").alias("l")).collect()}
    assert got == {0: ["a", "b"], 1: ["c"], 2: ["d", "e"], 3: ["z"], 4: [], 5: [], 6: []}
    rated = ['{"rating": 2}', '{"score": "1.5"}', "[1]", "[1, 2]", " 0 ", "I say 2 of 2", "3", "one", None, "a b c d e f g h 1"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rated)], "i int, s string")
    got = [r.v for r in df.orderBy("i").select(replies.rating_of(F.col("s")).alias("v")).collect()]
    assert got == [2.0, 1.5, 1.0, None, 0.0, 2.0, None, None, None, None]
    first = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert first(replies.mean_rating(F.lit(2.0), F.lit(None).cast("double"))) == 1.0 and first(F.isnan(replies.mean_rating(F.lit(None).cast("double"), F.lit(None).cast("double"))))
    texts = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert first(replies.preprocess_context(texts("a\n\n b", "c", ""), 2)) == ["a", "b"] and first(replies.preprocess_context(texts("-----g\n\nx", "y"), 1)) == ["-----g\n\nx\n\ny"]
    assert first(replies.preprocess_context(texts(" ", ""), 2)) == [] and first(replies.preprocess_context(F.lit(None).cast("array<string>"))) == []


def test_contract(spark):
    entity = {"type": "t", "name": "n", "description": "d"}
    item = {"title": "a", "content": "b", "is_valid": True, "entities": [entity]}
    cases = [
        ({"data": {"items": [item]}}, 0), ({"data": {"items": [item, item]}}, 1), ({"data": {"items": [item], "meta": 1}}, 1), ({"data": {"items": [item | {"x": 1}]}}, 1), ({"data": {"items": [item | {"title": " "}]}}, 1),
        ({"data": {"items": [item | {"entities": []}]}}, 1), ({"data": {"items": [item | {"entities": [entity | {"y": 2, "name": ""}]}]}}, 2), ({"data": {"items": [item | {"is_valid": "yes"}]}}, 1), ({"data": {}}, 1),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, s string")
    assert {r.i: len(r.errors) for r in replies.contract_errors(df, "i", "s").collect()} == {i: n for i, (_, n) in enumerate(cases)}


def test_flattened_items_of_any_depth(spark):
    leaf = {"title": "t", "content": "c", "is_valid": True}
    nest = leaf
    for _ in range(5):
        nest = leaf | {"children": [nest, leaf | {"is_valid": False, "children": [leaf]}]}
    df = spark.createDataFrame([("a", json.dumps({"data": {"items": [nest, leaf]}})), ("b", "no json"), ("c", None)], "k string, r string")
    rows = extraction.flatten_events(df, "k", "r").collect()
    assert sorted(r.path for r in rows) == ["0", "0.0", "0.0.0", "0.0.0.0", "0.0.0.0.0", "0.0.0.0.0.0", "1"] and max(r.level for r in rows) == 5
    with pytest.raises(RuntimeError):
        extraction.flatten_events(df, "k", "r", depth=3)


def test_types_and_thresholds(spark):
    schema = "type string, threshold double, weight double"
    own, general = (spark.createDataFrame(r, schema) for r in ([("a", 0.5, 2.0), ("a", 0.6, 3.0)], [("a", 0.9, 1.0), ("b", None, None)]))
    types = extraction.resolved_types([own, general])
    hits = spark.createDataFrame([(1, "a", 0.55), (2, "b", 0.7), (3, "c", 0.8), (4, "a", 0.4)], "id int, type string, score double")
    assert {(r.id, r.threshold, r.weight) for r in extraction.over_type_threshold(hits, types).collect()} == {(1, 0.5, 2.0), (3, 0.8, 1.0)}


def test_evidence(spark):
    stages = spark.createDataFrame([(1, "s", "e1"), (1, "s", "e2"), (1, "s", "e2"), (1, "t", "e3"), (2, "s", "e1")], "query_id int, stage string, id string")
    texts = spark.createDataFrame([("e1", "A  b"), ("e2", "a b "), ("e3", None)], "id string, text string")
    gold = spark.createDataFrame([(1, "a b"), (1, "A b"), (1, "zz"), (1, None)], "query_id int, text string")
    got = {r.stage: (r.n_candidates, r.hit, r.total, r.coverage, r.hit_ids) for r in metrics.evidence_coverage(stages, texts, gold).collect()}
    assert got == {"s": (2, 1, 2, 0.5, ["e1", "e2"]), "t": (1, 0, 2, 0.0, [])}
    facts = spark.createDataFrame([(1, 0, "T", 1), (1, 1, "T", 5), (1, 2, "U", 0), (1, 3, "T", -1)], "id int, at int, title string, sentence_index int")
    context = spark.createDataFrame([(1, 0, "T", ["x"]), (1, 1, "T", ["p", "q"])], "id int, at int, title string, sentences array<string>")
    assert [(r.at, r.sentence) for r in metrics.evidence_sentences(facts, context).collect()] == [(0, "q")]


def test_answer_scores_match_lists(spark):
    answers = spark.createDataFrame([(1, "The cat the cat"), (2, ""), (3, None), (4, "x")], "id int, answer string")
    golds = spark.createDataFrame([(1, "cat"), (1, "a cat sat"), (2, "a"), (3, "y"), (4, None)], "id int, gold string")
    got = {r.id: (r.em, round(r.f1, 6)) for r in metrics.answer_scores(answers, golds).collect()}
    assert got == {1: (0, round(2 / 3, 6)), 2: (1, 1.0), 3: (0, 0.0), 4: (0, 0.0)}


def test_score_missing_and_running_best(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7) + 1, float(i % 5)]) for i in range(60)], "id bigint, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.5])], "query_id bigint, vec array<double>")
    pairs = spark.createDataFrame([(1, 3), (1, 4), (1, 999)], "query_id bigint, id bigint")
    known = spark.createDataFrame([(1, 3, 0.123)], "query_id bigint, id bigint, score double")
    got = {r.id: r.score for r in knn.score_missing(pairs, known, queries, vectors).collect()}
    assert set(got) == {3, 4} and got[3] == 0.123
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # several batches in a task
    try:
        best = [r.id for r in knn.exact_knn(queries, vectors.coalesce(1), 10).orderBy("place").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert best == [r.id for r in knn.exact_knn(queries, vectors.coalesce(1), 10).orderBy("place").collect()]
