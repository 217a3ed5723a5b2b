"""Exact betweenness from all start nodes against plain Python, over more nodes than 200, in shares, small blocks and scratch files."""

from __future__ import annotations

import random

import pytest

from lodestack.operators import brandes as br
from lodestack.plans import graph_queries as gq
from lodestack.plans import registry
from tests.test_paths_topics import brandes, close

SHAPE = "a long, b long, weight double"


def some_edges(seed, nodes, links):
    """A ring, chords and a pair of nodes apart."""
    rng = random.Random(seed)
    chords = {tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(links)} - {(i, i + 1) for i in range(nodes)} - {(0, nodes - 1)}
    ring = [(i, i + 1, rng.choice([1.0, 2.0])) for i in range(nodes - 1)] + [(0, nodes - 1, 1.0)]
    return ring + [(a, b, rng.choice([0.2, 0.5, 1.0, 2.0, 4.0, rng.random() + 0.1])) for a, b in sorted(chords)] + [(nodes, nodes + 1, 3.0)]


def hops(edges):
    n = len({x for e in edges for x in e[:2]})
    return {k: v * (n - 1) * (n - 2) for k, v in brandes([(a, b, 1.0) for a, b, _ in edges]).items()}


def measured(frame):
    return {r.node: r.betweenness for r in frame.collect()}


def test_queries_start_from_every_node(spark, monkeypatch):
    """More than the 200 nodes that were start nodes before."""
    edges = some_edges(1, 260, 300)
    monkeypatch.setattr(gq, "sparse_edges", lambda *_: spark.createDataFrame(edges, SHAPE))
    run = registry.queries()
    assert close(measured(run["gra03_betweenness"](spark, "")), hops(edges))
    assert close(measured(run["gra03_weighted_betweenness"](spark, "")), brandes(edges))


@pytest.mark.parametrize(("cells", "held"), [(1 << 18, 1 << 24), (40, 1 << 24), (1, 25)])
def test_blocks_and_scratch_files(spark, monkeypatch, cells, held):
    import pyarrow as pa

    edges = some_edges(2, 30, 60)
    monkeypatch.setattr(br, "CELLS", cells)
    monkeypatch.setattr(br, "HELD", held)
    ways = sorted((x, y, 1 / w) for a, b, w in edges[:-1] for x, y in ((a, b), (b, a)))
    ways += [(x, y, length + 1) for x, y, length in ways[::3]]  # longer repeats
    rows = [("one", 3, (s << br.NODE_BITS) + x, y, length) for s in range(3) for x, y, length in sorted(ways, key=lambda way: way[0])]
    rows[len(ways) : len(ways)] = [("two", 1, 30, 31, 1.0), ("two", 1, 31, 30, 1.0)]
    names = ["component", "shares", "at", "other", "length"]
    cut = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + 7]]) for i in range(0, len(rows), 7)]
    for kernel, want in ((br._hops, hops(edges)), (br._lengths, {k: v * 31 * 30 for k, v in brandes(edges).items()})):
        got = dict.fromkeys(want, 0.0)
        for share, shares, graph in br._shares(iter(cut)):
            starts = br.np.arange(share, len(graph.nodes), shares)
            for i in range(0, len(starts), 4):
                for node, x in zip(graph.nodes.tolist(), kernel(graph, starts[i : i + 4])):
                    got[node] += x
        assert close(got, want)


def test_names_loops_and_repeats(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.4), ("c", "d", 2.0), ("x", "y", 1.0)]
    frame = spark.createDataFrame([*edges, ("a", "b", 0.5), ("c", "c", 9.0), ("z", "z", 1.0)], "a string, b string, weight double")
    assert close(measured(br.betweenness(frame, weighted=False)), hops(edges))
    assert close(measured(br.normalized(frame)), brandes(edges))
    assert br.betweenness(frame.limit(0)).count() == 0 and br.normalized(frame.limit(0)).count() == 0


def test_thinned_edges_connect_the_same(monkeypatch):
    monkeypatch.setattr(br, "CELLS", 20)
    import pyarrow as pa

    edges = [(i, i + 7) for i in range(100) if i % 10] + [(i % 5, 50) for i in range(90)]
    parts = [pa.RecordBatch.from_pydict({"a": [e[0] for e in p], "b": [e[1] for e in p]}) for p in (edges[:13], edges[13:90], edges[90:])]
    few = [tuple(r.values()) for b in br._thinned(iter(parts)) for r in b.to_pylist()]

    def roots(pairs):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in list(root)}

    assert roots(few) == roots(edges) and len(few) < len(edges)
