"""Fill-in-the-middle by piece tables, against plain string slicing."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack.llm import piecetable as pt
from lodestack.llm import queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [
    (1, "alpha beta\tgamma  delta \n"), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "é ñandú  \x0b 東京 x" * 50), (7, "has <P> inside"),
    (8, "has <S>"), (9, "<M>"), (10, "ends with < and <P"), (11, "< P> <"), (None, "no id here at all"), (12, "same row"), (12, "same row"), (12, "other text of the id"),
    (13, "word " * 40_000), (14, "x" * 300_000),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_version(doc_id, text, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_equals_slicing(spark, rate, spm):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = pt.restored(pt.fill_in_middle(docs, rate=rate, spm=spm)).collect()
    mine = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got]
    assert sorted(mine, key=key) == sorted((plain_version(d, t, rate, spm) for d, t in ODD), key=key)
    assert all(r.output_sha256 == sha(r.output) for r in got)
    assert sorted((r.doc_id, r.restored) for r in got if r.doc_id) == sorted((d, t or "") for d, t in ODD if d)


def test_whole_table_equals_slicing(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op12_fill_in_middle(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(rows)
    for d in docs:
        doc_id, n, form, prefix, middle, output = plain_version(d.doc_id, d.text)
        assert rows[d.doc_id] == (doc_id, n, form, prefix, middle, sha(output), sha(d.text or ""))


def test_equals_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = connection.sql(pt.ORACLE)
    got = queries.op12_fill_in_middle(spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall(), key=lambda r: r[0])


def test_pieces():
    whole = pt.Piece(pt.TEXT, 0, 10)
    left, right = pt.cut(whole, 4)
    assert (left, right) == (pt.Piece(0, 0, 4), pt.Piece(0, 4, 10))
    assert pt.cut(left, 0) == (pt.Piece(0, 0, 0), left) and pt.cut(right, 6)[1] == pt.Piece(0, 10, 10)
    with pytest.raises(ValueError):
        pt.cut(left, 5)
    for order in pt.ORDERS.values():
        assert pt.arranged(pt.arranged("PSMpms", order), pt.inverse(order)) == list("PSMpms")
    assert pt.digest([right, left], (b"0123456789", b"")) == hashlib.sha256(b"4567890123").hexdigest()


def test_descriptors_spell_the_output(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").where("doc_id is not null")
    for r in pt.fill_in_middle(docs, rate=100).collect():
        texts = [(t or "").encode() for d, t in ODD if d == r.doc_id]
        assert any(b"".join(pt.stream([pt.Piece(*p) for p in r.pieces], (t, pt.SENTINELS))).decode() == r.output for t in texts)


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pt.restored(pt.fill_in_middle(none)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "x", 3)], "`my.id` int, `the.text` string, form string, output int")
    row = pt.restored(pt.fill_in_middle(docs, "my.id", "the.text", rate=100).withColumn("restored", F.lit("clash"))).first()
    assert row.doc_id == 1 and row.form != "plain" and row.restored == "a b c"
