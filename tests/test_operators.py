"""Operators on small literal inputs."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from lodestack.functions import scalars as sc
from lodestack.operators import chunks, dedupe, filters, graph, hooks, normalize, search, trends
from lodestack.operators.components import connected_components
from lodestack.sources import records
from lodestack.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_keyword_forms(spark):
    rows = {"RAG": "retrieval augmented generation", "Large-Language_Models": "large language model", "studies": "study", "class": "class", "AI": "artificial intelligence", "C++": "c++"}
    got = spark.createDataFrame(list(rows.items()), "k string, w string").select(sc.normal_keyword(F.col("k")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)


def test_noise_keywords(spark):
    noise = ["cs.lg", "q bio ot", "cond mat", "Science", "journal of things", "context (archaeology)", "a. b", "x", "", None]
    fine = ["retrieval augmented generation", "protein folding"]
    rows = spark.createDataFrame([(k,) for k in noise + fine], "k string").select(filters.is_noise_keyword(F.col("k")).alias("n")).collect()
    assert [r.n for r in rows] == [True] * len(noise) + [False] * len(fine)
    reasons = {"q  bio ot": "category", "stat": "category", "physics": "discipline", "x": "letter", "heliyon": "venue", "old. new": "joined", "cs lg ml": None}
    given = spark.createDataFrame([(k,) for k in reasons], "k string").select("k", filters.noise_reason(F.col("k")).alias("r")).collect()
    assert {r.k: r.r for r in given} == reasons


def test_uid_ignores_case_and_space(spark):
    a, b = (one(spark, sc.author_uid(F.col("n")), n=n) for n in ("Ada  Chen", "ada chen "))
    assert a == b and len(a) == 40


def test_split_text(spark):
    text = "A" * 120 + ". " + "B" * 120
    parts = one(spark, chunks.split_text(F.col("t"), 100, 10), t=text)
    assert len(parts) >= 2 and all(len(p) <= 100 for p in parts) and parts[-1].endswith("B")
    assert one(spark, chunks.split_text(F.col("t"), 100, 10), t="  a \n b ") == ["a b"]
    with pytest.raises(ValueError):
        chunks.split_text(F.col("t"), 100, 60)


def test_sources_are_mapped(spark):
    raws = [
        ("openalex", {"id": "https://records.example/W77", "display_name": "Rivers <i>and</i> mills", "publication_year": 2019, "abstract_inverted_index": {"turn": [1, 3], "mills": [0], "slowly": [2]}, "authorships": [{"author": {"display_name": "Noor Idris"}}], "keywords": [{"display_name": "GNN"}], "concepts": [{"display_name": "faint", "score": 0.05}, {"display_name": "NLP", "score": 0.8}]}),
        ("arxiv", {"id": "http://arxiv.org/abs/1907.54321v3", "title": "Tides", "summary": "Of tides", "authors": ["Kai"], "published": "2019-07-30", "categories": ["math.PR"]}),
        ("pubmed", {"pmid": "12121212", "title": "Bones", "abstract": "Of bones", "authors": ["Kai"], "year": "2018", "keywords": ["bone-density"]}),
        ("crossref", {"DOI": "10.77/tide", "title": ["Tides"], "abstract": "<jats:p>Low <jats:b>water</jats:b></jats:p>", "author": [{"given": "Noor", "family": "Idris"}], "issued": {"date-parts": [[2017, 5, 6]]}}),
        ("doaj", {"id": "mill-9", "bibjson": {"title": "Mills", "author": [{"name": "Kai"}], "year": "2016", "keywords": ["weir"], "subject": [{"term": "hydrology"}]}}),
        ("nowhere", {"id": "9"}),
    ]
    rows = spark.createDataFrame([(s, "9", "water", "Hydrology", "later", json.dumps(r)) for s, r in raws], records.WRAPPER)
    got = {r.source: r for r in normalize.normal_papers(rows).collect()}
    assert (got["openalex"].paper_id, got["openalex"].abstract, got["openalex"].title) == ("W77", "mills turn slowly turn", "Rivers and mills")
    assert got["openalex"].keywords == ["graph neural network", "natural language processing"] or got["openalex"].keywords == ["gnn", "nlp"]
    assert (got["arxiv"].paper_id, got["arxiv"].year, got["arxiv"].keywords) == ("1907.54321", 2019, ["math.pr"])
    assert got["pubmed"].keywords == ["bone density"] and got["pubmed"].field == "hydrology"
    assert (got["crossref"].abstract, got["crossref"].authors, got["crossref"].year) == ("Low water", ["Noor Idris"], 2017)
    assert got["doaj"].keywords == ["weir", "hydrology"]
    assert got["nowhere"].invalid and not got["doaj"].invalid


def test_bad_lines_are_invalid_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source": "pubmed", "source_id": "1", "raw": {"pmid": "1"}}\n\n{"source": "pub\n')
    rows = records.read_wrappers(spark, str(tmp_path)).collect()
    assert sorted(r.invalid for r in rows) == [False, True]


def test_smaller_output_is_not_kept(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert records.replace_if_not_smaller(spark.range(3), path) == 3
    assert records.replace_if_not_smaller(spark.range(2), path) == 3
    assert spark.read.parquet(path).count() == 3
    assert records.replace_if_not_smaller(spark.range(4), path) == 4


def test_ambiguous_dois(spark):
    rows = spark.createDataFrame([(1, "10.1/a", "Old history of art", "openalex"), (2, "10.1/A", "Deep protein folding", "pubmed"), (3, "10.1/b", "Same title", "pubmed"), (4, "10.1/b", "Same title here", "pmc"), (5, None, None, "pmc")], "id int, doi string, title string, source string")
    got = {r.id: r.doi for r in dedupe.clear_ambiguous_dois(rows, "id", "doi", "title", "source", ["pubmed", "pmc"]).collect()}
    assert got == {1: "10.1/a", 2: "", 3: "10.1/b", 4: "10.1/b", 5: None}


def test_dois_on_titles_that_are_unlike_each_other_only(spark):
    """Two titles like the least one, but not like each other."""
    titles = ["aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaa bbbbbb", "aaaaaaaaaaaaaaaaaaaa cccccc"]
    rows = spark.createDataFrame([(i, "10.1/a", t, "pmc") for i, t in enumerate(titles)], "id int, doi string, title string, source string")
    assert {r.doi for r in dedupe.clear_ambiguous_dois(rows, "id", "doi", "title", "source", ["pmc"]).collect()} == {""}
    assert {r.doi for r in dedupe.clear_ambiguous_dois(rows.where("id < 2"), "id", "doi", "title", "source", ["pmc"]).collect()} == {"10.1/a"}


def test_session_memory_keeps_turn_order(spark, tmp_path):
    turns = [(1, k, f"fact {20 - k if k != 5 else 16}") for k in range(1, 19)]
    spark.createDataFrame(turns, "conv long, turn long, fact string").repartition(5).write.parquet(f"{tmp_path}/t.parquet")
    stream = jobs.stream(spark, f"{tmp_path}/t.parquet", 100)
    (row,) = jobs.drained(spark, jobs.session_memory(stream, "conv", "fact", "turn"), "memory", "update", ["session"]).collect()
    assert row.facts == ", ".join(f"fact {20 - k}" for k in range(7, 19))


def test_trend_tests(spark):
    rows = spark.createDataFrame([("up", [0.01, 0.02, 0.04, 0.08]), ("flat", [0.05] * 4), ("short", [0.1, 0.2])], "keyword string, values array<double>")
    got = {r.keyword: r for r in trends.with_p_value(trends.mann_kendall(rows)).collect()}
    assert got["up"].mk_s == 6 and got["up"].sen_slope > 0 and got["up"].mk_trend == "increasing"
    assert got["flat"].mk_p == 1 and got["flat"].mk_trend == "no-trend" and got["short"].mk_tau == 0
    assert abs(got["up"].mk_p - math.erfc(got["up"].mk_z / math.sqrt(2))) < 1e-4


def test_graph_measures(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0), ("x", "y", 2.0)], "a string, b string, weight double")
    assert {r.node: r.component for r in connected_components(edges, "a", "b").collect()} == dict(a="a", b="a", c="a", d="a", x="x", y="x")
    assert {r.node: r.core for r in graph.core_numbers(edges).collect()} == dict(a=2, b=2, c=2, d=1, x=1, y=1)
    assert abs(sum(r["rank"] for r in graph.page_rank(edges).collect()) - 1) < 1e-9
    labels = graph.communities(edges)
    assert graph.modularity(edges, labels).first()[0] >= graph.modularity(edges, connected_components(edges, "a", "b").toDF("node", "community")).first()[0] - 0.2
    got = {r.node: r.betweenness for r in graph.betweenness(edges, pivots=10).collect()}
    assert got["c"] == 4 and got["a"] == 0


def test_empty_tables(spark):
    edges = spark.createDataFrame([], "a string, b string, weight double")
    assert connected_components(edges, "a", "b").count() == 0
    assert graph.core_numbers(edges).count() == 0


def test_mmr_prefers_unlike(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.89, [1.0, 0.01]), (1, 3, 0.7, [0.0, 1.0])]
    got = search.mmr(spark.createDataFrame(rows, "query long, doc long, score double, vector array<double>"), 2).orderBy("position").collect()
    assert [r.doc for r in got] == [1, 3]


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.9), (1, 0, 0.9), (1, 0, 0.5), (0, 0, 0.9)], "s int, c int, b double")
    got = [r.v for r in rows.select(search.verdict(F.col("s"), F.col("c"), F.col("b")).alias("v")).collect()]
    assert got == ["disputed", "refuted", "strong", "partial", "insufficient"]


def test_article_xml(spark, tmp_path):
    cited = "<ReferenceList><Reference><ArticleIdList><ArticleId IdType='doi'>10.9/cited</ArticleId></ArticleIdList></Reference></ReferenceList>"
    article = lambda n, place, own: f"<PubmedArticle><MedlineCitation><PMID>{n}</PMID><Article><ArticleTitle>T{n}</ArticleTitle>{place}<Journal><Title>J</Title><JournalIssue><PubDate><Year>2024</Year></PubDate></JournalIssue></Journal><Abstract><AbstractText>A</AbstractText></Abstract><AuthorList><Author><LastName>Chen</LastName><ForeName>Ada</ForeName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList>{own}</ArticleIdList>{cited}</PubmedData></PubmedArticle>"
    place = "<ELocationID EIdType='doi'>10.1/place</ELocationID>"
    own = "<ArticleId IdType='pubmed'>1</ArticleId><ArticleId IdType='doi'>10.1/own</ArticleId>"
    (tmp_path / "a.xml").write_text("<Set>" + article(1, "", "<ArticleId IdType='pubmed'>1</ArticleId>") + article(2, place, own) + article(3, "", own) + "</Set>")
    got = {r.pmid: r for r in records.read_article_xml(spark, str(tmp_path)).collect()}
    assert {k: r.doi for k, r in got.items()} == {"1": "", "2": "10.1/place", "3": "10.1/own"}
    assert (got["1"].authors, got["1"].year, got["1"].abstract) == (["Ada Chen"], "2024", "A")


def test_text_candidates(spark):
    row = spark.createDataFrame([("arxiv", "10.1/x", "", "https://arxiv.org/pdf/2401.1", "2401.1")], "s string, d string, p string, u string, i string")
    got = row.select(records.text_candidates(*[F.col(c) for c in "sdpui"]).alias("c")).first().c
    assert [(c.url, c.reason) for c in got] == [("https://arxiv.org/pdf/2401.1", "preprint"), ("https://doi.org/10.1/x", "doi")]


def test_authorships(spark):
    raw = {"authorships": [
        {"author": {"id": "A1", "display_name": " Noor Idris ", "orcid": None}, "raw_orcid": "0000-7", "institutions": [{"id": "I1", "display_name": "Mill House", "country_code": "NO"}, {"id": "I2", "display_name": "Mill House"}], "affiliations": [{"institution_ids": ["I2", "I9"]}], "countries": ["SE"], "is_corresponding": True},
        {"author": {"display_name": ""}, "raw_author_name": " "},
        {"raw_author_name": "K. Lund", "author_position": "last"},
    ]}
    rows = spark.createDataFrame([(json.dumps(raw),), ("{}",), (None,)], "raw string").select(normalize.authorships(F.col("raw")).alias("a")).collect()
    first, last = rows[0].a
    assert (first.author_id, first.display_name, first.orcid, first.author_position, first.is_corresponding) == ("A1", "Noor Idris", "0000-7", "1", True)
    assert (first.institution_ids, first.institutions, first.country_codes) == (["I1", "I2", "I9"], ["Mill House"], ["SE", "NO"])
    assert (last.display_name, last.author_position, last.author_position_index) == ("K. Lund", "last", 3)
    assert not rows[1].a and not rows[2].a


def test_hooks(spark):
    """Encoders resume and keep their order; judges may be short, odd or fail; summaries default to joining."""
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id long, text string")
    done = spark.createDataFrame([(3, "size"), (1, "other")], "id long, model string")
    got = hooks.encoded(rows, lambda: lambda texts: [[len(t), 1] for t in texts], "id", "text", "size", prefix="q: ", batch=1, done=done).collect()
    assert {r.id: (r.model, r.vector) for r in got} == {1: ("size", [5.0, 1.0]), 2: ("size", [3.0, 1.0])}
    evidence = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "x")], "claim string, doc long, text string")

    def judge():
        def label(claim, texts):
            if claim == "b":
                raise ValueError(claim)
            return ["support ", "perhaps"]

        return label

    got = {(r.claim, r.doc): r.stance for r in hooks.judged(evidence, judge, "claim", "doc", "text", "judge").collect()}
    assert got == {("a", 1): "SUPPORT", ("a", 2): "NEUTRAL", ("a", 3): "NEUTRAL", ("b", 1): None}
    turns = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "s long, turn long, text string")
    assert {r.s: r.summary for r in hooks.summarised(turns, "s", "turn", "text").collect()} == {1: "a\nb", 2: ""}
    short = hooks.summarised(turns, "s", "turn", "text", "short", lambda: lambda texts: f"{len(texts)} turns")
    assert {r.s: r.summary for r in short.collect()} == {1: "2 turns", 2: "1 turns"}


def test_grounding_bands(spark):
    rows = [(0.6, False, None, "high"), (0.3, True, None, "high"), (0.3, False, None, "medium"), (0.0, True, None, "medium"), (0.1, False, None, "low"), (0.0, False, 0.81, "high"), (0.9, False, 0.5, "low"), (0.0, True, 0.71, "high"), (0.0, False, 0.63, "medium")]
    table = spark.createDataFrame(rows, "share double, cited boolean, cosine double, want string")
    assert all(r.got == r.want for r in table.select("want", search.grounding(F.col("share"), F.col("cited"), F.col("cosine")).alias("got")).collect())
    cited = spark.createDataFrame([("as [2] says", True), ("as [3] says", False), ("[0] none", False)], "t string, want boolean")
    assert all(r.got == r.want for r in cited.select("want", search.cites_evidence(F.col("t"), F.lit(2)).alias("got")).collect())


def test_communities_of_two_cliques(spark):
    rows = [(f"{side}{i}", f"{side}{j}", 1.0) for side in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 0.5)]
    edges = spark.createDataFrame(rows, "a string, b string, weight double")
    rows = graph.best_communities(edges, (1.0,)).collect()
    named = {r.node: r.community for r in rows if r.chosen}
    assert len(named) == len(rows) == 10 and all(len({named[f"{side}{i}"] for i in range(5)}) == 1 for side in "ab") and named["a0"] != named["b0"]
