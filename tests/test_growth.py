"""What large tables brought to light: rounds, rows and memory that grow no faster than the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestack.functions import scalars as sc
from lodestack.operators import expansion as ex
from lodestack.operators import graph as gr
from lodestack.operators import search as se


def counted(monkeypatch, module, name="stage"):
    """The calls of a function of a module, as they come."""
    calls, plain = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(a) or plain(*a, **k))
    return calls


def test_core_numbers_of_many_levels_take_few_rounds(spark, monkeypatch):
    n = 24  # i and j are linked if they add up to n or more: one level of cores after the other
    rows = [(i, j, 1.0) for i in range(1, n) for j in range(i + 1, n) if i + j >= n]
    calls = counted(monkeypatch, gr)
    got = {r.node: r.core for r in gr.core_numbers(spark.createDataFrame(rows, "a long, b long, weight double")).collect()}
    left, k, want = {x for a, b, _ in rows for x in (a, b)}, 0, {}
    while left:
        degree = {x: sum((a == x and b in left) or (b == x and a in left) for a, b, _ in rows) for x in left}
        k = max(k, min(degree.values()))
        gone = {x for x in left if degree[x] <= k}
        want |= dict.fromkeys(gone, k)
        left -= gone
    assert got == want
    assert len(calls) <= 8


def test_core_numbers_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)
    rows = [(i, j, 1.0) for i in range(6) for j in range(i + 1, 6)] + [(5, 6, 1.0), (5, 6, 2.0)]
    edges = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda r: (made.add(1), r)[1]), "a long, b long, weight double")
    assert {r.node: r.core for r in gr.core_numbers(edges).collect()} == {**dict.fromkeys(range(6), 5), 6: 1}
    assert made.value == len(rows)


def test_target_ranks_are_those_of_the_whole_list(spark, monkeypatch):
    monkeypatch.setattr(se, "TERM_BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 12, 6))) for i in range(60)] + [(7, "w1 w1 w2"), (60, None), (61, "w3")]
    docs = spark.createDataFrame(rows, "doc long, text string")
    terms = se.query_terms(docs.where("doc % 3 = 0 and doc < 60").withColumnRenamed("doc", "query"), "query", "text", most=4)
    terms = terms.union(spark.createDataFrame([(7, "w1"), (7, "nowhere")], "query long, term string"))
    targets = terms.select("query").distinct().selectExpr("query", "query as target")
    every = se.lexical(se.postings(docs, "doc", "text", terms), terms, 1000).where("query = doc")
    want = {(r.query, r["rank"]) for r in every.collect()}
    assert {(r.query, r["rank"]) for r in se.target_ranks(docs, "doc", "text", terms, targets).collect()} == want and len(want) == 21


def test_nearest_passes_on_ties_by_document(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40, 0, -1)] + [(0, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec long, v array<double>").coalesce(1)
    got = se.nearest(vectors, vectors.where("vec = 0"), "vec", "v", "vec", 3).orderBy("rank").collect()
    assert [r.doc for r in got] == [1, 2, 3]


def test_nearest_holds_small_matrices(spark, monkeypatch):
    monkeypatch.setattr(se, "CELLS", 50)
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(90)], "vec long, v array<double>")
    plain = np.array([r.v for r in vectors.orderBy("vec").collect()])
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    got = {(r.query, r["rank"]): r.doc for r in se.nearest(vectors, vectors.where("vec % 9 = 0"), "vec", "v", "vec", 5).collect()}
    for q in range(0, 90, 9):
        order = [d for d in np.argsort(-(plain @ plain[q])) if d != q][:5]
        assert [got[q, r] for r in range(1, 6)] == order


def test_questions_of_the_same_keywords_share_their_neighbours(spark, monkeypatch):
    sizes, plain = [], ex.few
    monkeypatch.setattr(ex, "few", lambda df, *a: sizes.append(df.count()) or plain(df, *a))
    name = dict(a="alpine lakes", b="bridge repair", c="copper mines", d="desert winds", e="elder trees")
    papers = spark.createDataFrame([(p, name[k]) for p, ks in enumerate(["ab", "abc", "bd", "ce", "abde"]) for k in ks], "doc long, kw string")
    asked = [(q, name["a"]) for q in range(50)] + [(q, name[k]) for q in range(50, 90) for k in "ab"]
    got = ex.neighbours(spark.createDataFrame(asked, "question long, keyword string"), papers, "doc", "kw", 2).collect()
    want = {"a": [("b", 3), ("c", 1)], "ab": [("d", 2), ("c", 1)]}
    rows = sorted((r.question, r["rank"], r.keyword, r.n) for r in got)
    assert rows == [(q, i, name[k], n) for q in range(90) for i, (k, n) in enumerate(want["a" if q < 50 else "ab"], 1)]
    assert sizes == [3]


def test_normal_keyword_squeezes_a_text_once(spark):
    df = spark.createDataFrame([("Graph_Theories ",), ("boxes",), ("glass",), (None,)], "t string").select(sc.normal_keyword(F.col("t")).alias("k"))
    assert [r.k for r in df.collect()] == ["graph theory", "boxe", "glass", ""]
    assert df._jdf.queryExecution().analyzed().toString().count("[^a-z0-9 +#]") == 1


def test_betweenness_takes_no_step_from_what_is_all_reached(spark, monkeypatch):
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(12) for j in range(i + 1, 12)] + [(0, 12, 1.0)], "a long, b long, weight double")
    calls = counted(monkeypatch, gr)
    got = {r.node: r.betweenness for r in gr.betweenness(edges).collect()}
    assert got == {i: 22.0 if i == 0 else 0.0 for i in range(13)}
    assert len(calls) == 6  # links, starts, two steps, all of them, one step back


def test_weighted_paths_pass_on_one_offer_a_row_in_blocks(spark, monkeypatch):
    from lodestack.operators import paths

    rng = np.random.default_rng(2)
    rows = [(f"n{i}", f"n{j}", float(rng.integers(1, 4))) for i in range(18) for j in range(i + 1, 18) if rng.random() < 0.7]
    edges = spark.createDataFrame(rows, "a string, b string, weight double").coalesce(1)
    want = {r.node: r.betweenness for r in paths.weighted_betweenness(edges, None).collect()}
    offers, plain = [], paths.stage
    monkeypatch.setattr(paths, "stage", lambda df, label: (offers.append(df.count()) if label == "offers" else None) or plain(df, label))
    monkeypatch.setattr(paths, "FEW", 100)
    monkeypatch.setattr(paths, "CELLS", 200)
    got = {r.node: r.betweenness for r in paths.weighted_betweenness(edges, None).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)
    assert len(offers) > 3 and sum(offers) < 2 * len(rows) * 18  # blocks; fewer than a row for each edge of each start


def test_ranked_texts_are_those_of_the_postings(spark, monkeypatch):
    monkeypatch.setattr(se, "CELLS", 40)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 15, 7))) for i in range(80)] + [(7, "w1 w1 w2"), (80, None), (81, "w3")]
    docs = spark.createDataFrame(rows, "doc long, text string").coalesce(2)
    terms = se.query_terms(docs.where("doc % 6 = 0 and doc < 80").withColumnRenamed("doc", "query"), "query", "text", most=4)
    terms = terms.union(spark.createDataFrame([(7, "w1"), (7, "nowhere"), (8, "nowhere")], "query long, term string"))
    want = se.lexical(se.postings(docs, "doc", "text", terms), terms, 5)
    got = se.ranked_texts(docs, "doc", "text", terms, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 75
    assert got.dtypes == want.dtypes


def test_terms_are_counted_by_buckets(spark, monkeypatch):
    from lodestack.operators import grams
    from lodestack.operators import textstats as ts

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 9) % 40)) for i in range(60)] + [(60, None), (61, "..."), (62, "w1")]
    docs = spark.createDataFrame(rows, "doc long, text string")
    want = ts.simple_tf_idf(ts.term_counts(docs, "doc", "text", 1, 3, ("w3",)), 63, 9).collect()
    means = ts.mean_tf_idf(ts.term_counts(docs, "doc", "text"), 63, 2, 0.9, 12, 9).collect()
    sums = counted(monkeypatch, grams, "term_sums")
    for first in (2, 1 << 14):  # too few buckets at first, or enough
        monkeypatch.setattr(grams, "FIRST", first)
        assert ts.simple_tf_idf_of(docs, "doc", "text", 63, 1, 3, ("w3",), 9).collect() == want
        got = ts.mean_tf_idf_of(docs, "doc", "text", 63, 1, 2, 2, 0.9, 12, 9).collect()
        assert [(r.term, r.df) for r in got] == [(r.term, r.df) for r in means] and all(abs(a.score - b.score) < 2e-6 for a, b in zip(got, means, strict=True))
    assert 4 < len(sums) <= 6
    twice = docs.union(docs.where("doc < 9"))  # texts of one id are one document, and no run goes over their border
    assert {r.df for r in ts.simple_tf_idf_of(twice, "doc", "text", 63, 1, 3, ("w3",), 9).collect()} <= set(range(1, 64))


def test_best_evidence_makes_the_matches_of_winners_alone(spark, monkeypatch):
    from lodestack.operators import evidence as ev

    rng = np.random.default_rng(6)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9, n))
    docs = spark.createDataFrame([(i, line(3), line(12)) for i in range(70)] + [(70, None, "w1"), (71, "none", None)], "doc long, title string, full_text string")
    asked = spark.createDataFrame([(q, line(5)) for q in range(12)] + [(12, "nowhere"), (13, "rag w1"), (14, None)], "q long, t string")
    fields, special = {n: F.col(n) for n in ("title", "full_text")}, {"rag": "w2 w3 w4"}
    want = ev.best_evidence(ev.evidence_scores(docs, "doc", fields, asked, "q", "t", special=special))
    scored, plain = [], ev.evidence_scores
    monkeypatch.setattr(ev, "evidence_scores", lambda docs, *a: scored.append(docs.count()) or plain(docs, *a))
    monkeypatch.setattr(ev, "CELLS", 60)
    monkeypatch.setattr(ev, "QUERY_BLOCK", 5)
    got = ev.best_evidence_of(docs, "doc", fields, asked, "q", "t", special=special).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 39
    assert scored[0] <= 39


def test_pairs_are_dealt_out_by_the_rows_there_are(spark, sf_dir, monkeypatch):
    from lodestack import storage
    from lodestack.plans import registry

    run = registry.queries()
    names = ("agg17_report_edges", "str03_incremental_edges")
    want = [sorted(map(tuple, run[n](spark, sf_dir).collect())) for n in names]
    monkeypatch.setattr(storage, "TASK_ROWS", 500)  # of 6,000 lines
    for name, rows in zip(names, want, strict=True):
        got = run[name](spark, sf_dir)
        assert sorted(map(tuple, got.collect())) == rows
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan


def test_topics_keep_no_words_and_settle_ties(spark, monkeypatch):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, CountVectorizerModel

    from lodestack.operators import textstats as ts

    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 45, 7)) + " Everywhere") for i in range(40)] + [(3, "w1 w2 w2"), (40, None), (41, "..."), (42, "once")]
    docs = spark.createDataFrame(rows, "doc long, t string").coalesce(2)
    words = [(t or "").lower().split() for _, t in rows if t and t != "..."]
    flat, df = [w for ws in words for w in ws], lambda w: sum(w in ws for ws in words)
    vocabulary = sorted((w for w in set(flat) if 2 <= df(w) <= 0.82 * len(words)), key=lambda w: (-flat.count(w), w))[:25]
    assert flat.count(vocabulary[-1]) == flat.count(vocabulary[-2]) and "everywhere" not in vocabulary
    tokens = docs.select("doc", ts.word_list(F.col("t")).alias("w")).where("size(w) > 0")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "w", "features").transform(tokens)
    model = LDA(k=3, maxIter=4, seed=7).fit(vectors)
    want = {(r.topic, k, vocabulary[i]) for r in model.describeTopics(5).collect() for k, i in enumerate(r.termIndices)}
    sure = sorted((r.doc, int(np.argmax(r.topicDistribution)), round(float(max(r.topicDistribution)), 6)) for r in model.transform(vectors).collect())
    monkeypatch.setattr(CountVectorizer, "fit", lambda *_: 1 / 0)  # it keeps all words of its input in memory
    ranked, best = ts.lda_topics(docs, "doc", "t", k=3, terms=25, rounds=4, words=5)
    assert set(map(tuple, ranked.collect())) == want
    assert sorted(map(tuple, best.collect())) == sure and len(sure) == len(words) == 42


def test_topic_years_keep_no_words_and_count_every_document(spark, sf_dir, monkeypatch):
    from pyspark.ml.feature import CountVectorizer

    from lodestack.plans import registry
    from lodestack.tables import table

    monkeypatch.setattr(CountVectorizer, "fit", lambda *_: 1 / 0)  # it keeps all words of its input in memory
    rows = registry.queries()["win10_topic_years"](spark, sf_dir).collect()
    docs = table(spark, sf_dir, "documents").where(F.lower("text").rlike(r"[\p{L}\p{N}]"))
    want = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    assert {lang: sum(r.n for r in rows if r.lang == lang) for lang in want} == want
    assert all(0 <= r.topic < 6 and 0 <= r.mean_weight <= 1 for r in rows)
