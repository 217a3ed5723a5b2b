"""Every registered query with SQL against DuckDB on the smallest data set."""

from __future__ import annotations

import math
import re

import duckdb
import pytest

from lodestack.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(columns, names, rows):
    at = [names.index(c) for c in columns]
    flat = [tuple(round(r[i], 6) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in at) for r in rows]
    return sorted(flat, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(name, spark, sf_dir, duck):
    got = registry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    mine, theirs = rows_of(columns, got.columns, [tuple(r) for r in got.collect()]), rows_of(columns, want.columns, want.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and abs(x - y) < 2e-6) or str(x) == str(y), (a, b)


#: What must hold of every row of a query that SQL does not express, and how many rows there are at least.
ROWS = {
    "agg23_chunk_summary": (1, lambda r: all(v is not None for v in r)),
    "gra03_betweenness": (5, lambda r: r.betweenness >= 0),
    "gra04_eigenvector": (5, lambda r: 0 <= r.value <= 1),
    "gra05_core_numbers": (5, lambda r: r.core >= 1),
    "gra07_communities": (5, lambda r: r.node is not None and r.community is not None and r.communities >= 1 and -1 <= r.modularity <= 1),
    "gra13_component_slices": (1, lambda r: r.a < r.b and r.weight > 0),
    "ret04_cell_search": (10, lambda r: -1.000001 <= r.cosine <= 1.000001 and 1 <= r["rank"] <= 10),
    "ret07_rerank": (1, lambda r: 1 <= r.new_rank <= 10),
    "ret11_mmr": (1, lambda r: 1 <= r.position <= 5),
    "sca01_uids": (1, lambda r: any(re.fullmatch("[0-9a-f]{40}", str(v)) for v in r)),
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_without_sql(name, spark, sf_dir):
    """There are rows, and they are as ``ROWS`` says."""
    least, holds = ROWS.get(name, (1, lambda r: any(v is not None for v in r)))
    rows = registry.queries()[name](spark, sf_dir).collect()
    assert len(rows) >= least and all(map(holds, rows))
