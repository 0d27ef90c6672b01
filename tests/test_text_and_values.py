import unicodedata
import uuid

from mnemograph.functions import dates, text
from mnemograph.functions.rouge import rouge, rouge_scores
from mnemograph.operators import extraction, metrics
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_scalars(spark):
    t = F.col("t")
    case = lambda c, v: one(spark, c, t=v)
    assert case(text.squeeze(t), "  a \n b\t") == "a b"
    assert case(text.headings(t), "# One\ntext\n  ### Two ##\n#no") == ["One", "Two ##"]
    assert case(text.truncate(t, 5), "abcdefgh") == "ab..." and case(text.truncate(t, 5), "abc") == "abc"
    assert case(text.heading_text(t), "## See [the page](http://x)  now") == "See the page now"
    assert case(text.paragraphs(t), "a\n\n \n\n b ") == ["a", "b"]
    assert case(text.estimate_tokens(t), "中文字abcd") == 3
    assert case(text.normalize_answer(t), "The  Cat, an (old) one!") == "cat old one"
    assert case(text.extract_answer(t), "Thought ... Answer: no. ANSWER: Yes ") == "Yes" and case(text.extract_answer(t), "plain") == "plain"
    assert case(text.strip_fence(t), "x ```json\n{\"a\":1}\n``` y") == '{"a":1}'
    assert case(text.ground_truths(t), '["a", "b"]') == ["a", "b"] and case(text.ground_truths(t), '"a"') == ["a"]
    assert case(text.ground_truths(t), "bare") == ["bare"] and case(text.ground_truths(t), None) == [] and case(text.ground_truths(t), "[broken") == ["[broken"]
    assert case(text.evidence_text(t), " A \n\n\n\nB  c ") == "a\n\nb c"
    assert case(text.clean_lines(t), "a   b\n\n\n\n c ") == "a b\n\nc"
    name = "Ｃａｆé ½　Ｘ"
    assert case(text.normalize_for_embedding(t), name) == " ".join(unicodedata.normalize("NFKC", name).lower().split())
    assert case(text.text_id(t), "a") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a"))
    assert case(text.entity_key(t), "Müller & Söhne, (KG) 中") == "müller söhne kg 中"
    assert one(spark, text.first_filled(F.col("v")), v=[" ", "x", "y"]) == "x" and one(spark, text.first_filled(F.col("v")), v=[" "]) is None
    assert one(spark, text.section_text(F.col("h"), F.col("b")), h="Title", b="## Title\nbody") == "Title\nbody"
    assert one(spark, text.rerank_text(F.col("a"), F.col("b"), F.col("i")), a=" ", b=None, i="id") == "id"


def test_dates(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    then = lambda s: F.lit(s).cast("timestamp_ntz")
    first = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert first(dates.time_ago(then("2024-02-29 23:59:30"), now)) == "just now" and first(dates.time_ago(then("2024-02-28 00:00:00"), now)) == "2 days ago"
    assert abs(first(dates.time_decay(then("2024-02-28 12:00:00"), now, 0.5)) - 2.718281828 ** (-0.5)) < 1e-6
    assert first(dates.parse_iso(F.lit("2024-01-01T10:00:00Z"))).hour == 10 and first(dates.parse_iso(F.lit("nonsense"))) is None
    assert first(dates.beijing(then("2024-01-01 20:00:00"))).day == 2
    meets = lambda a, b: first(dates.overlaps(then(a), then(b) if b else F.lit(None).cast("timestamp_ntz"), then("2024-01-10"), then("2024-01-20")))
    assert meets("2024-01-01", "2024-01-10") and not meets("2024-01-01", "2024-01-09") and meets("2024-01-15", None) and not meets("2024-01-01", None)


def test_rouge(spark):
    assert rouge("The cat sat.", "the cat sat") == (1.0,) * 9 and set(rouge("abc def", "xyz")) == {0.0} and set(rouge("", "")) == {0.0}
    assert abs(rouge("a b c d", "a c d e")[8] - 0.75) < 1e-9 and rouge("running", "run")[2] == 1.0 and rouge("relational", "digit")[2] == 0.0
    row = spark.createDataFrame([("one two", None)], "g string, p string").select(rouge_scores("g", "p").alias("r")).first().r
    assert row.rouge1_f == 0


def test_list_metrics(spark):
    row = spark.createDataFrame([(["a", "a", "b", "c"], ["a", "b", "z"], ["a", "x", "a"])], "got array<string>, gold array<string>, said array<string>")
    got, gold = F.col("got"), F.col("gold")
    r = row.select(
        metrics.distinct_recall(got, gold, 3).alias("r"), metrics.counted_recall(got, gold, 3).alias("c"), metrics.list_precision(got, gold, 9).alias("p"), metrics.strict_precision(got, gold, 10).alias("s"),
        metrics.reciprocal_rank(F.array(F.lit("q"), F.lit("b")), gold).alias("m"), metrics.token_f1(F.col("said"), F.array(F.lit("a"), F.lit("a"))).alias("f"), metrics.hit_class(got, gold, 4).alias("h"),
        metrics.ndcg(F.array(F.lit("a"), F.lit("q")), F.array(F.lit("a")), 2).alias("n"), metrics.distinct_recall(got, F.array().cast("array<string>"), 3).alias("e"),
        metrics.f_beta(F.lit(3), F.lit(0), F.lit(0)).alias("b1"), metrics.f_beta(F.lit(0), F.lit(3), F.lit(3)).alias("b0"), metrics.f_beta(F.lit(1), F.lit(1), F.lit(1), 2.0).alias("b2"), metrics.f_beta(F.lit(1), F.lit(1), F.lit(1), 1.0).alias("b3"),
    ).first()
    assert (r.r, r.c, r.p, r.s, r.m, r.h, r.n, r.e) == (2 / 3, 1.0, 0.5, 0.3, 0.5, "partial", 1.0, 0.0)
    assert abs(r.f - 0.8) < 1e-9 and r.b1 > 0.999 and r.b0 < 1e-6 and r.b2 > r.b3


def test_averages_and_merging(spark):
    rows = spark.createDataFrame([("m", 1.0), ("m", float("nan")), ("m", 0.0), ("n", float("nan"))], "metric string, value double")
    got = {r.metric: (r["mean"], r.n) for r in metrics.averages(rows).collect()}
    assert got["m"] == (0.5, 2) and got["n"][1] == 0 and got["n"][0] != got["n"][0]
    old = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.3, 0.4)], "id int, a double, b double")
    new = spark.createDataFrame([(2, None, 0.9), (3, 0.5, None)], "id int, a double, b double")
    assert {tuple(r) for r in metrics.merged_results(old, new, "id", ["a", "b"]).collect()} == {(1, 0.1, 0.2), (2, 0.3, 0.9), (3, 0.5, None)}
    done = spark.createDataFrame([(1, 0.1), (2, float("nan"))], "id int, a double")
    assert {r.id for r in metrics.ids_to_rerun(spark.createDataFrame([(1,), (2,), (3,)], "id int"), done, "id", "a").collect()} == {2, 3}


REPLY = """{"data": {"items": [
 {"title": "A", "references": ["1", "9", "x"], "entities": [{"type": "person", "name": "P"}], "children": [{"title": "B", "children": [{"title": "C"}]}, {"title": "gone", "is_valid": false, "children": [{"title": "D"}]}]},
 {"title": "no", "is_valid": false}]}}"""


def test_flatten_events(spark):
    df = spark.createDataFrame([(1, REPLY), (2, "no json"), (3, None)], "id int, reply string")
    rows = {r.title: r for r in extraction.flatten_events(df, "id", "reply").collect()}
    assert set(rows) == {"A", "B", "C"} and (rows["B"].parent, rows["C"].level, rows["C"].path) == ("0", 2, "0.0.0")
    refs = spark.createDataFrame([(["1", "9", "x"], ["s1", "s2"]), (["x"], ["s1", "s2"]), (None, ["s1"])], "r array<string>, ids array<string>")
    got = [r.x for r in refs.select(extraction.resolve_references(F.col("r"), F.col("ids")).alias("x")).collect()]
    assert got == [["s1"], ["s1", "s2"], ["s1"]]


def test_entities(spark):
    m = spark.createDataFrame([("s", "person", " Anna B ", 2), ("s", "person", "anna b", 1), ("s", "person", "x", 1), (None, "person", "Anna", 1), ("s", None, "Anna", 1), ("t", "person", "Anna B", 3)], "src string, kind string, name string, pos int")
    rows = extraction.distinct_entities(m, "src", "kind", "name", "pos").collect()
    assert {(r.source, r.key, r.name, r.mentions) for r in rows} == {("s", "anna b", "anna b", 2), ("t", "anna b", "Anna B", 1)} and len({r.id for r in rows}) == 2
    d = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "b", 3), (1, " ", 0), (1, None, 0)], "k int, d string, pos int")
    assert [r.descriptions for r in extraction.merged_descriptions(d, ["k"], "d", ["pos"]).collect()] == ["a、b"]
