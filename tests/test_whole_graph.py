"""The graph queries over every edge, against plain Python."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import pytest

from lodestack.operators import graph
from lodestack.operators.components import connected_components
from lodestack.plans import registry
from lodestack.plans.roles import BASKETS_SQL
from tests.test_oracles import TABLES, rows_of


@pytest.fixture(scope="module")
def edges(sf_dir):
    duck = duckdb.connect()
    for name in TABLES:
        duck.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return duck.sql(f"with {BASKETS_SQL} select x.author, y.author, count(*)::double from doc_authors x join doc_authors y on x.doc_id = y.doc_id and x.author < y.author group by all").fetchall()


def cores(edges):
    near = defaultdict(set)
    for a, b, *_ in edges:
        near[a].add(b)
        near[b].add(a)
    out, k = {}, 0
    while near:
        node = min(near, key=lambda n: len(near[n]))
        k = max(k, len(near[node]))
        out[node] = k
        for other in near.pop(node):
            near[other].discard(node)
    return out


def sliced(edges, nodes=10, most=16):
    """Of one component."""
    rows, weight = sorted(edges, key=lambda e: (-e[2], e[0], e[1])), defaultdict(float)
    for a, b, w in rows:
        weight[a] += w
        weight[b] += w
    kept = {min(weight, key=lambda n: (-weight[n], n))}
    while len(kept) < nodes and (crossing := [e for e in rows if (e[0] in kept) != (e[1] in kept)]):
        kept |= set(crossing[0][:2])
    return sorted([e for e in rows if e[0] in kept and e[1] in kept][:most])


def test_queries_take_all_edges(spark, sf_dir, edges):
    run = registry.queries()
    assert len(edges) == 45
    assert {r.node: r.core for r in run["gra05_core_numbers"](spark, sf_dir).collect()} == cores(edges)
    assert {r.node for r in run["gra03_betweenness"](spark, sf_dir).collect()} == set(cores(edges))
    assert sorted((r.a, r.b, r.weight) for r in run["gra13_component_slices"](spark, sf_dir).collect()) == sliced(edges)


def test_slice_grows_from_the_heaviest_node_of_all_edges(spark):
    """A hub of 300 light edges outweighs the nodes that hold the hundred heaviest edges."""
    rows = [(0, n, 1.0) for n in range(100, 400)] + [(a, b, 5.0) for a in range(1, 21) for b in range(a + 1, 21)] + [(20, 100, 0.5)]
    edges = spark.createDataFrame(rows, "a long, b long, weight double")
    got = graph.component_slices(edges, connected_components(edges, "a", "b")).collect()
    assert sorted((r.a, r.b, r.weight) for r in got) == sliced(rows) and {r.a for r in got} == {0}


def test_components_where_their_sql_has_rows(spark):
    name, sf_dir = "gra06_components", "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = registry.queries()[name](spark, sf_dir), duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    mine = rows_of(columns, got.columns, [tuple(r) for r in got.collect()])
    assert mine and mine == rows_of(columns, want.columns, want.fetchall())
