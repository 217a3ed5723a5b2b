"""Rows of one id with different texts, indexes reopened by a later session, and items shorter than a shingle."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from lodestack.llm import decontaminate
from lodestack.llm.neardup import near_duplicates
from lodestack.llm.substring import FingerprintIndex, remove_repeats
from lodestack.storage import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


def repeats_by_row(rows):
    """Smaller ids are earlier; rows of one id are not earlier than each other."""
    windows = [(d, {tuple(w[k : k + 20]) for k in range(len(w) - 19)}) for d, w in ((d, WORD.findall(t or "")) for d, t in rows)]
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        before = set().union(*(s for o, s in windows if d is not None and o is not None and o < d))
        gone, own = [False] * len(w), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in before or x in own:
                gone[k : k + 20] = [True] * 20
            own.add(x)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


L = words(200, 1)
SPLIT_IDS = [
    [(1, L), (2, words(100, 2) + " " + L), (2, "five short words only here"), (4, words(300, 3) + " " + L + " " + words(300, 4))],
    [(1, "two words"), (1, L), (1, L + " " + L), (3, words(40, 5)), (5, L[: len(L) // 2]), (5, words(30, 6) + " " + L), (5, None), (None, L), (9, words(10, 7)), (9, L)],
    [(7, words(60, 8)), (7, words(10, 9) + " " + words(60, 8)), (8, words(60, 8) + " tail"), (8, words(60, 8) + " tail"), (8, "")],
]


@pytest.mark.parametrize("batches", [1, 2, 3])
@pytest.mark.parametrize("rows", SPLIT_IDS)
def test_repeats(spark, rows, batches):
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = remove_repeats(frame, batches=batches).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == repeats_by_row(rows)


def test_index_of_a_later_session(spark):
    path = new_path(spark, "index")
    rows = [(i, f"start{i} " + words(30 + i, i) + " " + L) for i in range(6)] + [(9, words(25, 3))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    first = FingerprintIndex(spark, path=path)
    first.absorb(table.where("doc_id < 3"))
    first.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]
    second = FingerprintIndex(spark, path=path)
    assert len(second.runs) == 1
    got = {r.doc_id for r in second.absorb(table.where("doc_id >= 3"), table.where("doc_id < 3")).collect()}
    assert got == {3, 4, 5, 9}  # 9 repeats words of document 3
    third = FingerprintIndex(spark, path=path)
    assert len(third.runs) == 2
    third.close()
    second.store.delete()
    assert FingerprintIndex(spark, path=path).runs == []


def components_by_row(rows, size):
    """Each row is a node; a component is named by its least id."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
    out = []
    for k, (d, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None), default=None)
        out.append((d, len(sets[k]), least, least is None or d == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("size, parts", [(2, 1), (5, 4)])
def test_near_duplicates(spark, size, parts):
    a, b = words(120, 11), words(90, 12)
    rows = [
        (1, a), (5, a + " more words"), (5, b), (5, b), (7, b + " at the end"), (7, "only two"), (8, "only two"), (0, words(50, 13)), (9, None), (9, a), (None, a), (3, ""),
        (6, words(200, 14)), (6, words(201, 15)), (2, words(200, 14) + " x"),
    ]
    for order in (rows, sorted(rows, key=lambda r: len(r[1] or ""))):
        frame = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        got = near_duplicates(frame, shingle=size).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted(map(tuple, got), key=str) == components_by_row(rows, size)


def test_pipeline_keeps_the_unique_text_of_an_id(spark, sf_dir):
    a, b, c = words(120, 21), words(90, 22), words(80, 23)
    rows = [(1, a), (5, a + " end"), (5, b), (7, b + " end"), (8, c), (8, c + " end"), (None, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, sf_dir).collect()), key=str)
    assert [r for r in kept if r[0] != 8] == sorted([(1, a), (5, b), (None, a)], key=str)
    assert len([r for r in kept if r[0] == 8]) == 1


def test_items_shorter_than_a_shingle(spark):
    docs = [(1, "one two three"), (2, "zero one TWO three four five six"), (3, "three two one"), (4, "one"), (5, None), (6, ""), (7, "a b c d e f"), (8, "x a b c d e y")]
    items = [(1, "one two three"), (2, "One"), (3, "a b c d"), (4, "a b c d e"), (5, ""), (6, None), (7, "five six"), (7, "two three"), (8, "not here")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 7), (3, 2), (4, 2), (7, 3), (8, 3), (7, 4), (8, 4)}
    connection = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        connection.register(name, pa.table({key: [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert sorted(tuple(r) for r in got) == sorted(connection.sql(decontaminate.ORACLE).fetchall())
