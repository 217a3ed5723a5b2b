"""Removal of repeated byte strings, against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import queries, suffixes
from lodestack.llm.suffixes import SuffixFamily, keyed, remove_repeated_bytes
from lodestack.storage import new_path


def brute(docs, window=200):
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(r[i : i + window] for _, r in raws for i in range(len(r) - window + 1))
    out = []
    for d, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(r) else 0
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def found(spark, docs, parts=3, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in remove_repeated_bytes(frame, keep_bytes=True, **more).collect()), key=str)


def noise(n, seed):
    return "".join(random.Random(seed).choices("abcdefghij klmnop", k=n))


A, B, C = noise(260, 1), noise(200, 2), noise(1500, 3)
DOCS = [
    (1, "x" + A + "y"), (2, noise(50, 4) + A[:230] + noise(30, 5)), (3, noise(300, 6)), (4, noise(40, 7) + A[30:]), (5, None), (6, ""), (7, B), (8, B),
    (9, B[:199]), (10, "é" * 150), (11, C), (12, noise(400, 8) + C[100:900] + noise(10, 9) + C[700:1300]), (13, "=" * 900), (14, noise(70, 10) + "=" * 250),
    (15, C[:350] + C[:350]), (16, "ab" * 300), (17, "日本語テキスト" * 40), (18, A[:199] + "Q" + A[200:]),
]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_equals_brute_force(spark, batches):
    assert found(spark, DOCS, batches=batches) == brute(DOCS)


def test_ids_with_several_texts(spark):
    """First, in the middle and last of a slice; each text is judged by itself."""
    docs = [
        (1, A), (1, noise(20, 11)), (2, noise(300, 12) + A), (2, "five short words only here"), (4, noise(300, 13) + A + noise(300, 14)), (4, A[:220]),
        (None, A), (None, noise(260, 15)), (None, "x"), (5, B), (5, B), (9, noise(90, 16)), (9, noise(900, 17) + B),
    ]
    for batches in (1, 2, 3):
        assert found(spark, docs, 1, batches=batches) == brute(docs)


def test_many_spans_of_one_anchor(spark, monkeypatch):
    """Whole groups go by window rows where they are large."""
    docs = [(i, noise(30 + i % 7, 100 + i) + A[: 215 + i % 40] + noise(20, 200 + i)) for i in range(60)]
    assert found(spark, docs) == brute(docs)
    monkeypatch.setattr(suffixes, "GROUP", 4)
    assert found(spark, docs) == brute(docs)


def test_pieces_of_long_documents(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice([A, B, C, noise(90, rng.randint(0, 40))]) for _ in range(20))) for i in range(6)]
    assert found(spark, docs) == brute(docs)
    long = noise(6_000_000, 77)
    rows = {r[0]: r for r in found(spark, [(1, long), (2, long[4_193_000:4_195_500]), (3, noise(3000, 78))])}
    assert [rows[d][2:4] for d in (1, 2, 3)] == [(2500, 1), (2500, 1), (0, 0)]


def test_later_session(spark):
    """A family is reopened by its path; old places that were alone are listed when something repeats them."""
    path = new_path(spark, "family")
    first, second = (keyed(spark.createDataFrame(rows, "doc_id long, text string")) for rows in ([(1, A), (2, C)], [(3, noise(99, 20) + A), (4, C[:800])]))
    family = SuffixFamily(spark, path)
    assert family.absorb(first).count() == 0
    family.store.close()
    again = SuffixFamily(spark, path)
    assert len(again.store.runs) == 1
    ids = {r.doc_id for r in again.absorb(second, first).collect()}
    assert ids == {1, 2, 3, 4}
    again.store.close()
    third = SuffixFamily(spark, path)
    assert [r.level for r in third.store.runs] == [1]  # two arrays of level 0 were merged
    assert third.absorb(keyed(spark.createDataFrame([(5, noise(300, 21))], "doc_id long, text string")), first.union(second)).count() == 0
    third.store.delete()
    assert SuffixFamily(spark, path).store.runs == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_suffix_order():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    for window in (16, 30, 200):
        starts = np.sort(rng.choice(3000 - window, 500, replace=False))
        order, same = suffixes.sorted_windows(data, starts, window)
        have = [bytes(data[s : s + window]) for s in starts[order]]
        assert have == sorted(have) and same.tolist() == [i > 0 and have[i] == have[i - 1] for i in range(500)]


def test_empty_and_clashing(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, A, 3, "p"), (2, A, 4, "q")], "`my.id` int, `the.text` string, version int, anchor string")
    assert [r.n_removed for r in remove_repeated_bytes(docs, "my.id", "the.text").collect()] == [260, 260]


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")).collect()
    want = [r[:5] for r in brute([tuple(r) for r in rows])]
    assert sorted(map(tuple, queries.op11_suffix_arrays(spark, sf_dir).collect()), key=str) == sorted(want, key=str)
