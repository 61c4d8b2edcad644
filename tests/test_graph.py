"""Centrality and communities against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.retrieval import cooccurrence

SCHEMA = "a string, b string, weight long"


def ranks(edges, damping=0.85, rounds=200):
    names = sorted({x for e in edges for x in e[:2]})
    to = {v: {} for v in names}
    for a, b, w in edges:
        to[a][b] = to[a].get(b, 0) + w
        to[b][a] = to[b].get(a, 0) + w
    now = dict.fromkeys(names, 1 / len(names))
    for _ in range(rounds):
        after = dict.fromkeys(names, (1 - damping) / len(names))
        for v in names:
            for u, w in to[v].items():
                after[u] += damping * now[v] * w / sum(to[v].values())
        now = after
    return now


def brute_modularity(edges, group):
    m = 2 * sum(w for *_, w in edges)
    k = {}
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inside = sum(2 * w for a, b, w in edges if group[a] == group[b])
    return inside / m - sum(k[x] * k[y] for x, y in itertools.product(k, k) if group[x] == group[y]) / m**2


@pytest.mark.parametrize("part", [10_000, 3])
def test_pagerank_equals_loops(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)
    rng = random.Random(1)
    edges = sorted({tuple(sorted(rng.sample("abcdefghij", 2))) for _ in range(18)} | {("a", x) for x in "bcdefghij"})
    edges = [(a, b, rng.randint(1, 5)) for a, b in edges]
    odd = [(None, "a", 1), ("a", "a", 9), ("x", "y", 0), ("b", "a", 2)]
    got = {r.entity: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges + odd, SCHEMA), tolerance=1e-10).collect()}
    want = ranks([*edges, ("b", "a", 2)])
    assert set(got) == set(want) and all(abs(got[v] - want[v]) < 1e-8 for v in want)
    assert graph.pagerank(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("part", [10_000, 3])
def test_pagerank_of_contexts_equals_that_of_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(12)}", f"e{rng.randrange(20)}") for _ in range(90)] + [("alone", "x"), (None, "e1"), ("c1", None), ("c1", "e2"), ("c1", "e2")]
    mentions = spark.createDataFrame(rows, "c string, e string")
    want = {r.entity: r["rank"] for r in graph.pagerank(cooccurrence(mentions, "c", "e")[0], rounds=7, tolerance=0).collect()}
    got = {r.entity: r["rank"] for r in graph.pagerank_of_contexts(mentions, "c", "e", rounds=7, tolerance=0).collect()}
    assert set(got) == set(want) and "x" not in got and all(abs(got[v] - want[v]) < 1e-12 for v in want)
    assert graph.pagerank_of_contexts(mentions.limit(0), "c", "e").count() == 0


def test_no_pair_is_made_for_central_users(spark):
    """A context of 40,000 entities has 800 million pairs; each of its entities has the same share."""
    mentions = spark.range(40_000).select(F.lit("c").alias("c"), F.col("id").alias("e"))
    got = graph.pagerank_of_contexts(mentions, "c", "e", rounds=2).agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b")).first()
    assert got.n == 40_000 and abs(got.a - 1 / 40_000) < 1e-15 and abs(got.b - 1 / 40_000) < 1e-15


def test_planted_communities_are_found(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 5)
    rng = random.Random(3)
    group = {f"{g}{k}": g for g in "xyz" for k in range(7)}
    edges = [(a, b, 1) for a, b in itertools.combinations(sorted(group), 2) if rng.random() < (0.9 if group[a] == group[b] else 0.05)]
    frame = spark.createDataFrame(edges, SCHEMA)
    found = graph.communities(frame)
    got = {r.entity: r.community for r in found.collect()}
    assert {a: got[a] == got[b] for a, b in itertools.combinations(group, 2)} == {a: group[a] == group[b] for a, b in itertools.combinations(group, 2)}
    assert set(got.values()) == {"x0", "y0", "z0"}
    assert abs(graph.modularity(frame, found) - brute_modularity(edges, got)) < 1e-9
    assert graph.communities(frame.limit(0)).count() == 0


def test_no_grouping_of_a_small_graph_is_better(spark):
    """Two triangles and a bridge, against every grouping there is."""
    edges = [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1), ("d", "e", 1), ("e", "f", 1), ("d", "f", 1)]
    got = {r.entity: r.community for r in graph.communities(spark.createDataFrame(edges, SCHEMA)).collect()}
    best = max(brute_modularity(edges, dict(zip("abcdef", g, strict=True))) for g in itertools.product(range(3), repeat=6))
    assert abs(brute_modularity(edges, got) - best) < 1e-12


@pytest.mark.parametrize("most", [8192, 3])
def test_communities_of_contexts_equal_those_of_pairs(spark, monkeypatch, most):
    for name in ("VERTICES", "COMMUNITIES", "AT_ONCE"):
        monkeypatch.setattr(graph, name, most)
    rng = random.Random(7)
    rows = [(f"{g}{rng.randrange(8)}", f"{g if rng.random() < 0.8 else 'q'}{rng.randrange(9)}") for g in "xyz" for _ in range(45)] + [("alone", "x"), (None, "x1"), ("x1", None)]
    mentions = spark.createDataFrame(rows, "c string, e string")
    want = {r.entity: r.community for r in graph.communities(cooccurrence(mentions, "c", "e")[0], rounds=6, levels=3).collect()}
    got = {r.entity: r.community for r in graph.communities_of_contexts(mentions, "c", "e", rounds=6, levels=3).collect()}
    assert got == want and len(set(got.values())) > 1
    assert graph.communities_of_contexts(mentions.limit(0), "c", "e").count() == 0


def test_no_pair_is_made_for_user_communities(spark, sf_dir, monkeypatch):
    from lodestone.plans import queries

    monkeypatch.setattr(queries.retrieval, "cooccurrence", None)
    assert queries.QUERIES["user_communities"](spark, sf_dir).count() > 0
