"""Weighted betweenness against Dijkstra's algorithm, PageRank that settles, matrix factors, and empty inputs."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import cooccurrence, graph, paths, search, textstats, topics
from lodestack.plans import registry
from lodestack.plans.roles import BASKETS_SQL


def brandes(edges, starts=None):
    """Normalized betweenness with 1/weight as length; ties by a relative 1e-9."""
    near = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = 1 / w
    total, n = dict.fromkeys(near, 0.0), len(near)
    for s in starts if starts is not None else near:
        dist, heap, done = {s: 0.0}, [(0.0, s)], []
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.append(v)
            for o, length in near[v].items():
                if d + length < dist.get(o, np.inf) * (1 - 1e-9):
                    dist[o] = d + length
                    heapq.heappush(heap, (d + length, o))
        order = sorted(dist, key=dist.get)
        tight = {v: [o for o, length in near[v].items() if abs(dist[o] + length - dist[v]) <= 1e-9 * dist[v]] if v != s else [] for v in order}
        count, flow = dict.fromkeys(order, 0.0), dict.fromkeys(order, 0.0)
        count[s] = 1.0
        for v in order[1:]:
            count[v] = sum(count[o] for o in tight[v])
        for v in reversed(order):
            for o in tight[v]:
                flow[o] += count[o] / count[v] * (1 + flow[v])
            if v != s:
                total[v] += flow[v]
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return {v: x * scale for v, x in total.items()}


def close(got, want):
    return set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_hops_and_lengths_disagree(spark):
    """The direct edge is light, so the way round over heavy edges is shorter; two ways are equally short."""
    edges = [(1, 2, 0.1), (1, 3, 10.0), (3, 2, 10.0), (2, 4, 1.0), (1, 5, 10.0), (5, 2, 10.0), (6, 7, 2.0), (4, 8, 0.5), (8, 9, 0.25)]
    got = {r.node: r.betweenness for r in paths.weighted_betweenness(spark.createDataFrame(edges, "a long, b long, weight double"), None).collect()}
    assert close(got, brandes(edges)) and got[3] == got[5] > 0 and got[7] == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, rng.choice([0.2, 0.5, 1.0, 2.0, 4.0, rng.random() + 0.1])) for a in range(24) for b in range(a + 1, 24) if rng.random() < 0.2]
    frame = spark.createDataFrame(edges + edges[:3] + [(5, 5, 1.0)], "a long, b long, weight double")
    assert close({r.node: r.betweenness for r in paths.weighted_betweenness(frame).collect()}, brandes(edges))


def test_query_on_all_edges(spark):
    sf_dir = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for name in ("lineitem", "orders", "part", "customer"):
        duck.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    edges = duck.sql(f"with {BASKETS_SQL} select x.author, y.author, count(*)::double from doc_authors x join doc_authors y on x.doc_id = y.doc_id and x.author < y.author group by all").fetchall()
    got = {r.node: r.betweenness for r in registry.queries()["gra03_weighted_betweenness"](spark, sf_dir).collect()}
    assert len(got) == 100 and close(got, brandes(edges)) and max(got.values()) > 0


def test_pivots_scale_up(spark):
    edges = [(i, i + 1, 1.0) for i in range(40)]
    frame = spark.createDataFrame(edges, "a long, b long, weight double")
    some = {r.node: r.betweenness for r in paths.weighted_betweenness(frame, 20).collect()}
    exact = brandes(edges)
    assert set(some) == set(exact) and abs(sum(some.values()) / sum(exact.values()) - 1) < 0.5


def test_page_rank_settles(spark):
    """On a long path ten rounds are not enough."""
    edges = [(i, i + 1, 1.0 + i % 3) for i in range(30)]
    m = np.zeros((31, 31))
    for a, b, w in edges:
        m[a, b] = m[b, a] = w
    rank = np.full(31, 1 / 31)
    for _ in range(500):
        rank = 0.15 / 31 + 0.85 * (m / m.sum(1, keepdims=True)).T @ rank
    got = {r.node: r["rank"] for r in graph.page_rank(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert max(abs(got[i] - rank[i]) for i in range(31)) < 1e-9


def test_empty_inputs(spark):
    edges = spark.createDataFrame([], "a long, b long, weight double")
    assert graph.page_rank(edges).count() == 0 and paths.weighted_betweenness(edges).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, v array<double>")
    assert search.nearest(vectors, vectors.limit(0), "id", "v", "id", 3).count() == 0
    assert search.nearest(vectors.limit(0), vectors, "id", "v", "id", 3).count() == 0
    assert textstats.cell_search(vectors.limit(0), vectors, "id", "v").count() == 0
    docs = spark.createDataFrame([], "doc long, t string")
    assert all(x.count() == 0 for x in textstats.lda_topics(docs, "doc", "t"))
    factors = topics.Factors.fit(*topics.tf_idf_rows(docs, "doc", "t"), 3)
    assert factors.words().count() == 0 and factors.topics().count() == 0


def test_nearest_with_names(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>")
    got = {(r.query, r["rank"]): r.doc for r in search.nearest(vectors, vectors, "id", "v", "id", 1).collect()}
    assert got == {("a", 1): "b", ("b", 1): "a", ("c", 1): "b"}


def test_planted_topics(spark):
    rng = random.Random(4)
    planted = [[f"t{k}w{i}" for i in range(12)] for k in range(4)]
    docs = [(d, " ".join(rng.choices(planted[d % 4], k=30) + rng.choices(["common", "words", "only"], k=5))) for d in range(120)] + [(200, None), (201, "")]
    rows, names = topics.tf_idf_rows(spark.createDataFrame(docs, "doc long, t string"), "doc", "t")
    factors = topics.Factors.fit(rows, names, 4)
    assert all(b <= a + 1e-9 for a, b in zip(factors.losses, factors.losses[1:], strict=False)) and len(factors.losses) < 220
    found = {r.doc: r.topic for r in factors.topics().collect()}
    assert set(found) == set(range(120)) and len({(d % 4, t) for d, t in found.items()}) == 4
    words = defaultdict(set)
    for r in factors.words(8).collect():
        words[r.topic].add(r.term[:2])
    assert all(len(v) == 1 for v in words.values()) and len(words) == 4


def test_losses_fall_on_the_documents(spark, sf_dir):
    rows, names = topics.tf_idf_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    losses = topics.Factors.fit(rows, names, 4).losses
    assert len(losses) > 2 and all(b <= a * (1 + 1e-9) for a, b in zip(losses, losses[1:], strict=False))


def test_pairs_of_large_documents(spark, monkeypatch):
    items = [(1, i) for i in range(23)] + [(2, i) for i in (3, 1, 2, 2)] + [(3, 7), (4, None)]
    frame = spark.createDataFrame(items, "doc long, item long")
    want = sorted((r.doc, r.n, r.a, r.b) for r in cooccurrence.document_pairs(frame, "doc", "item").collect())
    monkeypatch.setattr(cooccurrence, "LARGE", 5)
    assert sorted((r.doc, r.n, r.a, r.b) for r in cooccurrence.document_pairs(frame, "doc", "item").collect()) == want
    assert len(want) == 23 * 22 // 2 + 3


def test_vocabulary_first_changes_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = docs.count()
    a = textstats.mean_tf_idf(textstats.term_counts(docs, "doc_id", "text"), n).collect()
    b = textstats.mean_tf_idf_of(docs, "doc_id", "text", n).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 50


def test_topic_trends(spark):
    shares = spark.createDataFrame([("a", y, 10 * (y - 1999)) for y in range(2000, 2006)] + [("b", 2000, 5)], "topic string, year int, papers long")
    words = spark.createDataFrame([("a", "x; y")], "topic string, words string")
    got = {r.topic: r for r in topics.topic_trends(shares, words, list(range(2000, 2006))).collect()}
    assert got["a"].y2005 == 60 and got["a"].next_year == 2005 and got["a"].forecast == pytest.approx(55.0) and got["a"].trend_slope == pytest.approx(10.0)
    assert got["b"].y2003 == 0 and got["b"].words is None and got["b"].forecast >= 0
    assert topics.topic_trends(shares, words, [2000]).where(F.col("topic") == "b").first().forecast == 5
