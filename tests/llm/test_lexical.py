"""Ranked search in blocks, against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestack.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, query in asked.items():
        scores = []
        for d, bag, n in bags:
            score = 0
            for t, times in query.items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * (25 + 75 * n * n_docs // length)))
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(i, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")


def found(spark, docs, items, k=10):
    return sorted(map(tuple, lexical.ranked(*frames(spark, docs, items), k).collect()), key=str)


def corpus(n, seed):
    """Documents around a few subjects, many exact copies among them."""
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(20)]
    subjects = [[f"s{s}x{i}" for i in range(30)] for s in range(6)]
    docs = []
    for d in range(n):
        if docs and rng.random() < 0.3:
            docs.append((d, docs[0][1]))
        else:
            docs.append((d, " ".join(rng.choices(common, k=rng.randint(1, 30)) + rng.choices(rng.choice(subjects), k=rng.randint(0, 25)))))
    items = [(i, " ".join(rng.choices(common, k=6) + rng.choices(rng.choice(subjects), k=6))) for i in range(25)]
    return docs, items


def test_equals_scoring_all(spark, monkeypatch):
    docs, items = corpus(900, 1)
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_small_blocks_slices_and_rounds(spark, monkeypatch):
    docs, items = corpus(400, 2)
    for name, value in (("BLOCK", 3), ("SLICE_DOCS", 40), ("CELLS", 500), ("SEED", 15), ("ASKED", 60)):
        monkeypatch.setattr(lexical, name, value)
    assert found(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    docs = [
        (1, "Alpha beta GAMMA"), (2, None), (3, ""), (4, " \n ... --- "), (5, "alpha-beta_gamma"), (5, "alpha"), (5, "alpha"), (None, "alpha beta"),
        (6, "É é ñ Straße 東京 42 ALPHA"), (7, "filler " * 50_000 + "omega"), (8, "beta" * 40_000),
    ]
    items = [(1, "alpha beta gamma"), (2, None), (3, ""), (4, "é Ñ STRASSE straße 東京 42"), (5, "omega filler filler"), (6, "alpha"), (6, "alpha"), (6, "gamma"), (7, "absent"), (None, "beta alpha beta")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(30, 3)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == [] and found(spark, docs, [(1, "...")]) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2)], "`my.id` int, `the.text` string, text string, score int")
    items = spark.createDataFrame([(9, "a b", "q")], "`an.item` int, `its.text` string, doc_id string")
    got = lexical.ranked(docs, items, 10, "my.id", "the.text", "an.item", "its.text")
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and [tuple(r)[:3] for r in got.collect()] == [(9, 1, 1)]


def test_summaries_bound_their_documents(spark, monkeypatch):
    """The product with a block's summary is at least the score of each of its documents."""
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rng = np.random.default_rng(4)
    asked = lexical._Asked(np.arange(50, dtype=np.uint64), np.arange(50, dtype=np.uint64), np.array([0, 20, 50]), np.concatenate([np.arange(0, 40, 2), np.arange(20, 50)]), rng.integers(1, 4, 50))
    cells = np.where(rng.random((60, 50)) < 0.3, rng.integers(1, 1000, (60, 50)), 0)
    unit = cells.astype(np.float32)
    members = list(lexical._clusters(np.arange(60), unit))
    assert sorted(np.concatenate(members).tolist()) == list(range(60)) and max(map(len, members)) <= 4

    def products(rows):
        first = np.concatenate([[0], np.cumsum((rows > 0).sum(1))])
        pairs = np.repeat(np.arange(len(rows)), 2), np.tile([0, 1], len(rows))
        return lexical._products(asked, first, np.nonzero(rows)[1], rows[rows > 0], *pairs).reshape(-1, 2)

    for own in members:
        assert (products(cells[own].max(axis=0, keepdims=True)) >= products(cells[own])).all()


def test_whole_table_equals_sql(spark, sf_dir):
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    want = connection.sql(lexical.ORACLE)
    got = queries.op13_ranked_search(spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize("parts", [1, 7])
def test_same_however_dealt(spark, parts):
    docs, items = corpus(200, 5)
    a, b = frames(spark, docs, items)
    assert sorted(map(tuple, lexical.ranked(a.repartition(parts), b).collect()), key=str) == brute(docs, items)
