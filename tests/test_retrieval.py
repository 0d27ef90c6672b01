import math
import random

import numpy as np
import pytest

from mnemograph.operators import bm25, filters, graph, ranking
from mnemograph.operators.components import connected_components
from mnemograph.operators.knn import exact_knn, score_pairs
from mnemograph.plans import retrieval
from mnemograph.plans.config import FastConfig, GraphConfig, ScopeConfig, VectorConfig
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_config_ranges():
    with pytest.raises(ValueError):
        VectorConfig(similarity_threshold=1.5)
    with pytest.raises(ValueError):
        GraphConfig(max_hops=-1)
    assert FastConfig().max_sections == 10


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6)).round(2)
    vectors = frame(spark, [(i, v.tolist(), i % 3, "clash") for i, v in enumerate(x)], "id int, vec array<double>, grp int, query_id string").select(F.col("id").cast("bigint"), "vec", "grp")
    queries = vectors.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (1 + u @ u.T) / 2
    got = {(r.query_id, r.place): r.id for r in exact_knn(queries, vectors, 4, group_type="int", skip_self=True).collect()}
    for q in range(0, 80, 9):
        near = sorted((-round(s[q, i], 9), i) for i in range(80) if i != q and i % 3 == q % 3)[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in near]
    assert exact_knn(queries.limit(0), vectors, 4).count() == 0
    assert exact_knn(queries, vectors.limit(0), 4).count() == 0
    pairs = frame(spark, [(0, 5), (9, 9)], "query_id bigint, id bigint")
    assert {round(r.score, 9) for r in score_pairs(pairs, queries, vectors).collect()} == {round(s[0, 5], 9), 1.0}


def test_knn_in_blocks(spark, monkeypatch):
    from mnemograph.operators import knn

    monkeypatch.setattr(knn, "BLOCK_NUMBERS", 12)
    v = frame(spark, [(i, [math.cos(i), math.sin(i)]) for i in range(40)], "id bigint, vec array<double>")
    q = v.withColumnRenamed("id", "query_id")
    assert exact_knn(q, v, 1).where("query_id != id").count() == 0


def test_bm25_contract(spark):
    docs = frame(spark, [(1, "red fox", "the quick red fox"), (2, None, "a slow red dog dog dog"), (3, "", ""), (4, None, None)], "id bigint, heading string, content string")
    q = frame(spark, [(1, "red DOG"), (2, "  "), (3, "cat")], "query_id bigint, text string")
    index = bm25.Index(docs, "id", ["heading", "content"])
    rows = {(r.query_id, r.id): r.score for r in bm25.search(q, index, {"heading": 1.0, "content": 1.0}).collect()}
    assert set(rows) == {(1, 1), (1, 2)} and rows[1, 2] > rows[1, 1]
    idf = lambda n, df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    want = idf(2, 1) * 3 / (3 + 1.2 * (0.25 + 0.75 * 6 / 5)) + idf(2, 2) * 1 / (1 + 1.2 * (0.25 + 0.75 * 6 / 5))
    assert abs(rows[1, 2] - want) < 1e-9
    among = frame(spark, [(1, 1)], "query_id bigint, id bigint")
    assert [r.id for r in bm25.search(q, index, {"heading": 1.0, "content": 1.0}, among).collect()] == [1]


def test_written_index(spark, tmp_path):
    rng = random.Random(2)
    rows = frame(spark, [(i, " ".join(rng.choice("red green blue sea tree".split()) for _ in range(rng.randrange(0, 9))), rng.choice([None, "sea x"])) for i in range(60)], "id int, a string, b string")
    index = bm25.Index(rows, "id", ["a", "b"])
    index.write(str(tmp_path / "index"), buckets=4)
    again = bm25.Index.read(spark, str(tmp_path / "index"))
    q = frame(spark, [(1, "sea tree"), (2, "none"), (3, " ")], "query_id int, text string")
    boosts = {"a": 2.0, "b": 1.0}
    got, want = (sorted((r.query_id, r.id, round(r.score, 9)) for r in bm25.search(q, i, boosts).collect()) for i in (again, index))
    assert got == want and len(got) > 20
    empty = bm25.Index(rows.limit(0), "id", ["a"])
    empty.write(str(tmp_path / "none"))
    assert bm25.search(q, empty, boosts).count() == 0


def test_top_and_threshold(spark):
    rows = frame(spark, [(1, "low", 0.5), (1, "high", 2.0), (1, "mid", 1.5)], "query_id int, id string, score double")
    assert [r.id for r in ranking.top(rows.where(filters.at_least(F.col("score"), 1.0)), 2).orderBy("place").collect()] == ["high", "mid"]


def test_capped_pairs(spark):
    edges = frame(spark, [("e1", "x"), ("e2", "x"), ("e3", "x"), ("e4", "y")], "event_id string, entity_id string")
    seeds = frame(spark, [(1, "x"), (1, "y")], "query_id int, entity_id string")
    got = graph.capped_pairs(seeds, edges, 2, frame(spark, [(1, "e1")], "query_id int, event_id string"))
    assert sorted(r.event_id for r in got.collect()) == ["e2", "e3", "e4"]
    assert sorted(r.entity_id for r in graph.entities_of_events(frame(spark, [(1, "e2")], "query_id int, event_id string"), edges, 5).collect()) == ["x"]


def test_active_ids_keep_their_order(spark):
    wanted = frame(spark, [("e1", 0), ("e2", 1), ("e3", 2)], "id string, pos int")
    active = frame(spark, [("e2",), ("e1",)], "id string")
    assert [r.id for r in filters.in_given_order(wanted, active, "id").orderBy("pos").collect()] == ["e1", "e2"]
    assert filters.allowed(wanted, None, "id").count() == 3 and filters.allowed(wanted, active.limit(0), "id").count() == 0


def refilled(listed, said, top_k, most, threshold):
    """What a plain loop makes of one query's candidates (id, score) in order and a model's scores."""
    sound = {i: s for i, s in said.items() if s == s and abs(s) != float("inf") and i in dict(listed)}
    if not sound:
        return [(i, True) for i, _ in listed][:most]
    order = [i for i, _ in listed]
    head = sorted(sound, key=lambda i: (-sound[i], order.index(i)))[:top_k]
    rest = sorted((x for x in listed if x[0] not in head and x[1] >= threshold), key=lambda x: (-x[1], order.index(x[0])))
    return ([(i, False) for i in head] + [(i, True) for i, _ in rest])[:most]


def test_rerank_fill_against_a_loop(spark):
    rng = random.Random(12)
    lists = {q: [(f"v{i}", rng.choice([0.15, 0.35, 0.55, 0.75])) for i in rng.sample(range(40), 9)] for q in range(8)}
    said = {q: {f"v{i}": rng.choice([0.1, 0.6, 0.8, float("nan"), float("inf")]) for i in rng.sample(range(40), 14)} for q in range(7)}
    c = frame(spark, [(q, i, s, n) for q, l in lists.items() for n, (i, s) in enumerate(l)], "query_id int, id string, score double, pos int")
    m = frame(spark, [(q, i, s) for q, d in said.items() for i, s in d.items()], "query_id int, id string, score double")
    got = {}
    for r in ranking.rerank_fill(c, m, 2, 5, 0.3).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.id, r.is_fill))
    assert got == {q: refilled(lists[q], said.get(q, {}), 2, 5, 0.3) for q in lists}


SIM = [(1, "e1", 0.4, 0), (1, "e3", 0.9, 1), (1, "e2", 0.9, 2), (1, "e4", 0.7, 3)]


def test_picks_by_index_and_by_line(spark):
    c = frame(spark, [(1, "a", 0, "Alpha"), (1, "b", 1, "Beta [x]"), (1, "c", 2, "Alpha"), (2, "d", 0, None)], "query_id int, id string, pos int, text string")
    picks = lambda *rows: frame(spark, [(q, list(p)) for q, p in rows], "query_id int, picks array<string>")
    ids = lambda df: [(r.query_id, r.id) for r in df.orderBy("query_id", "place").collect()]
    assert ids(ranking.picked_by_index(c, picks((1, ["2", " 0", "2", "7", "x"]), (3, ["0"])), 5)) == [(1, "c"), (1, "a")]
    assert ids(ranking.picked_by_line(c, picks((1, ["no brackets", "[9] Beta [x]", "[ 2 ] anything", "[?] Alpha", "[8] Gamma"]), (2, ["[0]"])), 5)) == [(1, "b"), (1, "c"), (1, "a"), (2, "d")]
    assert ids(ranking.picked_by_index(c, picks((1, ["0", "1", "2"])), 2)) == [(1, "a"), (1, "b")]


def test_native_fill(spark):
    s = frame(spark, [(1, "c1", 1), (1, "c2", 2)], "query_id int, chunk_id string, place int")
    n = frame(spark, [(1, "c2", 1), (1, "c9", 2), (1, "c8", 3), (2, "c5", 1)], "query_id int, chunk_id string, place int")
    got = [(r.query_id, r.chunk_id, r.is_fill) for r in ranking.native_fill(s, n, 3).orderBy("query_id", "place").collect()]
    assert got == [(1, "c1", False), (1, "c2", False), (1, "c9", True), (2, "c5", True)]


def test_scope_keeps_inside(spark):
    queries, seeds, edges, vectors = small_graph(spark)
    relations = graph.relations_of(edges, vectors)
    config = ScopeConfig(event_top_k=2, query_events=1, relation_threshold=0.0)
    got = retrieval.scoped_candidates(queries, seeds, edges, vectors, relations, config, id_type="string", query_type="string")
    assert {r.id for r in got.collect()} == {"e1", "e2"}  # e3 shares the entity but is out of scope
    wide = retrieval.scoped_candidates(queries, seeds, edges, vectors, relations, ScopeConfig(query_events=1, relation_threshold=0.0), id_type="string", query_type="string")
    assert {r.id for r in wide.collect()} == {"e1", "e2", "e3"}
    none = retrieval.scoped_candidates(queries.limit(0), seeds.limit(0), edges, vectors, relations, config, id_type="string", query_type="string")
    assert none.count() == 0


def test_containing_and_exact_names(spark):
    rng = random.Random(6)
    texts = {i: "".join(rng.choice("abAB ") for _ in range(rng.randrange(0, 40))) for i in range(40)} | {98: None, 99: "x" * 5000}
    needles = [*("".join(rng.choice("abB ") for _ in range(rng.randrange(1, 6))) for _ in range(25)), "", None, "x" * 3000]
    rows = frame(spark, list(texts.items()), "id int, t string")
    asked = frame(spark, [(n,) for n in needles], "n string")
    got = {(r.id, r.needle) for r in filters.containing(rows, "id", "t", asked, "n").collect()}
    assert got == {(i, n) for i, t in texts.items() for n in needles if t and n and n.lower() in t.lower()}
    names = frame(spark, [(1, "A"), (2, "A"), (3, "a"), (4, None)], "id int, name string")
    assert {r.id for r in filters.exact_names(names, "name", frame(spark, [("A",), (None,)], "name string"), 1, [F.col("id")]).collect()} == {1}




def test_reply_fill(spark):
    c = frame(spark, SIM, "query_id int, id string, score double, pos int")
    replies = frame(spark, [(1, "best are [2] and [ 0 ], then [2], [9]")], "query_id int, reply string")
    got = [(r.id, r.is_fill, r.failed) for r in ranking.reply_fill(c, replies, 3).orderBy("place").collect()]
    assert got == [("e2", False, False), ("e1", False, False), ("e3", True, False)]
    got = [(r.id, r.failed) for r in ranking.reply_fill(c, frame(spark, [(1, "none")], "query_id int, reply string"), 2).orderBy("place").collect()]
    assert got == [("e1", True), ("e3", True)]


def test_rank_fusion_and_union_against_lists(spark):
    rng = random.Random(3)
    vec = [(q, f"d{i}", rng.random()) for q in range(4) for i in rng.sample(range(20), 12)]
    key = [(q, f"d{i}", rng.random()) for q in range(4) for i in rng.sample(range(20), 9)]
    schema = "query_id int, id string, score double"
    got = ranking.reciprocal_rank_fusion(frame(spark, vec, schema), frame(spark, key, schema), 60, 6).collect()
    for q in range(4):
        a = [i for _, i, _ in sorted([x for x in vec if x[0] == q], key=lambda x: (-x[2], x[1]))]
        b = [i for _, i, _ in sorted([x for x in key if x[0] == q and x[1] in a], key=lambda x: (-x[2], x[1]))]
        score = {i: 1 / (61 + a.index(i)) + 1 / (60 + (b.index(i) + 1 if i in b else len(a) + 1)) for i in a}
        want = sorted(a, key=lambda i: (-round(score[i], 9), i))[:6]
        assert [r.id for r in sorted(got, key=lambda r: r.place) if r.query_id == q] == want
    parts = [[(1, "a", 0), (1, "b", 1)], [(1, "b", 0), (1, None, 1), (1, "c", 2)]]
    union = ranking.ordered_union([frame(spark, p, "query_id int, id string, pos int") for p in parts])
    assert [r.id for r in union.orderBy("pos").collect()] == ["a", "b", "c"]


def test_first_of_each(spark):
    rows = frame(spark, [(1, "c1", 0), (1, "c1", 1), (1, None, 2), (1, None, 3)], "q int, chunk string, pos int")
    assert ranking.first_of_each(rows, ["q", "chunk"], [F.col("pos")]).count() == 2
    assert ranking.first_of_each(rows, ["q", "chunk"], [F.col("pos")], keep_null="chunk").count() == 3


def small_graph(spark):
    vectors = frame(spark, [("e1", [1.0, 0.0]), ("e2", [0.8, 0.6]), ("e3", [0.0, 1.0]), ("e9", [-1.0, 0.0])], "id string, vec array<double>")
    edges = frame(spark, [("e1", "x"), ("e2", "y"), ("e1", "y"), ("e3", "y"), ("e9", "z")], "event_id string, entity_id string")
    queries = frame(spark, [("q", [1.0, 0.1], "word")], "query_id string, vec array<double>, text string")
    seeds = frame(spark, [("q", "x")], "query_id string, entity_id string")
    return queries, seeds, edges, vectors


def test_graph_search_hops_and_routes(spark):
    queries, seeds, edges, vectors = small_graph(spark)
    config = GraphConfig(query_events=1, max_results=5)
    ranked, routes = retrieval.graph_search(queries, seeds, edges, vectors, config, id_type="string", query_type="string")
    assert [r.id for r in ranked.orderBy("place").collect()] == ["e1", "e2", "e3"]  # e2, e3 by the shared entity y
    answers = frame(spark, [("q", "e3")], "query_id string, node string")
    back = {(r.from_node, r.to_node) for r in graph.trace_back(answers, routes, 5).collect()}
    assert back == {("y", "e3"), ("e1", "y"), ("q", "e1"), ("x", "e1"), ("q", "x")}
    none, _ = retrieval.graph_search(queries.limit(0), seeds.limit(0), edges, vectors, config, id_type="string", query_type="string")
    assert none.count() == 0


def test_hydrate(spark):
    ranked = frame(spark, [("q", "e1", 1), ("q", "e2", 2), ("q", "e3", 3)], "query_id string, id string, place int")
    events = frame(spark, [("e1", "a1"), ("e2", None), ("e3", "a1")], "event_id string, source_id string")
    chunks = frame(spark, [("c1", "a1", 0, None, None), ("c2", "a1", 1, "h", "t")], "chunk_id string, article_id string, chunk_rank int, heading string, content string")
    rows = retrieval.hydrate(ranked, events, chunks, 10).collect()
    assert [(r.event_id, r.chunk_id, r.heading, r.content) for r in rows] == [("e1", "c1", "", "")]


def test_graph_statistics(spark):
    edges = frame(spark, [("e1", 1), ("e1", 2), ("e2", 2), ("e3", 9)], "event_id string, entity_id bigint")
    named = edges.select(F.col("event_id").alias("src"), F.col("entity_id").cast("string").alias("dst"))
    r = graph.bipartite_metrics(edges, connected_components(named)).first()
    assert (r.n_nodes, r.n_edges, r.n_events, r.n_entities, r.n_components, r.giant_size) == (6, 4, 3, 3, 2, 4)
    assert r.max_degree == 2 and r.degree_over_1 == 2 and abs(r.density - 8 / 30) < 1e-8 and r.mean_size == 3
    tri = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 3), (5, 5)], "src int, dst int")
    assert {(t.node, t.triangles) for t in graph.triangles(tri).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert graph.degree_distribution(edges).first().degree == 1
