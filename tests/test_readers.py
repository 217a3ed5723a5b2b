"""Readers and text helpers that no registered query needs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestack.functions import scalars as sc
from lodestack.sources import records


def test_papers_from_json_and_csv(spark, tmp_path):
    papers = [{"paper_id": "1", "title": 'A "quoted", title'}, {"paper_id": "2", "title": "two\nlines"}]
    (tmp_path / "p.json").write_text(json.dumps(papers))
    (tmp_path / "p.csv").write_text('paper_id,title\n1,"A ""quoted"", title"\n2,"two\nlines"\n')
    for name in ("p.json", "p.csv"):
        got = records.read_papers(spark, str(tmp_path / name)).orderBy("paper_id").collect()
        assert [(str(r.paper_id), r.title) for r in got] == [(p["paper_id"], p["title"]) for p in papers]
    with pytest.raises(ValueError):
        records.read_papers(spark, str(tmp_path / "p.txt"))


def test_chunks_of_some_types(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"id": i, "chunk_type": t}) for i, t in enumerate(["abstract", "full_text", "other"])))
    got = records.read_chunks(spark, str(tmp_path / "c.jsonl"), "id long, chunk_type string", ["abstract", "full_text"])
    assert {r.id for r in got.collect()} == {0, 1}


def test_latex(spark):
    texts = [
        "\\section{Intro} Hello % a comment\nworld", "a \\begin{figure}[t] x \\caption{y} \\end{figure} b", "50\\% of {\\bf all} $x$", None,
        "\\begin{table} one \\end{table}\\subsection*{Two} \\cite[p. 3]{key} end",
    ]
    got = [r.o for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sc.without_latex(F.col("t")).alias("o")).orderBy("i").collect()]
    assert got[0] == "Intro. Hello world" and got[1] == "a b" and got[3] is None and got[4] == "Two. end"
    assert "$" not in got[2] and "{" not in got[2] and "all" in got[2]


def test_quota_and_backfill(spark):
    rows = spark.createDataFrame([(q, f"{q}{i}") for q in "ab" for i in range(5)] + [("a", " "), ("b", "a0")], "query string, key string")
    picked = records.quota_sample(rows, "query", "key", 5, 2).collect()
    assert len(picked) == 6 and len({r.key for r in picked}) == 6 and all(r.key.strip() for r in picked)
    short = rows.where("query = 'a' and key < 'a2'")
    more = records.quota_sample(short, "query", "key", 4, 1, rows).collect()
    assert len(more) == 4 and {"a0", "a1"} <= {r.key for r in more} and len({r.key for r in more}) == 4


def test_body_of_a_nested_article(spark):
    article = """<article><front><title>Not here</title><p>nor this</p></front><body id="b"><sec><title>One &amp; all</title><p>First <i>words</i>.</p>
    <sec><title>Inner</title><p class="x">Second</p><p> </p></sec></sec><sec><title>Two</title><p>Third</p></sec></body><back><p>references</p></back></article>"""
    rows = [(0, article), (1, "<article>no body</article>"), (2, None), (3, "<body></body>")]
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, x string").select("i", sc.body_parts(F.col("x")).alias("p")).select("i", "p", sc.body_excerpt(F.col("p"), 15).alias("e")).collect()}
    assert [(x.kind, x.text) for x in got[0].p] == [("title", "One & all"), ("paragraph", "First words ."), ("title", "Inner"), ("paragraph", "Second"), ("title", "Two"), ("paragraph", "Third")]
    assert got[0].e == "First words . S" and all(got[i].p == [] and got[i].e == "" for i in (1, 2, 3))
