"""Tables of terms, concepts, filler, the taxonomy cascade and evidence by phrases, against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.functions import lookups as L
from lodestack.functions import scalars as sc
from lodestack.operators import evidence as ev
from lodestack.operators import terms as tm


def one_pass(text, terms):
    """At each place the longest term, from the left."""
    out, at, hit = [], 0, False
    while at < len(text):
        best = max((t for t in terms if t and text.startswith(t, at)), key=len, default=None)
        out.append(f" {terms[best]} " if best else text[at])
        hit, at = hit or best is not None, at + len(best or "x")
    return " ".join("".join(out).split()) if hit else text


def column(spark, texts, expression):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.o for r in frame.select("i", expression(F.col("t")).alias("o")).orderBy("i").collect()]


def test_trie_finds_the_longest_term():
    rng = random.Random(1)
    for _ in range(200):
        terms = {"".join(rng.choices("ab.", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        text = "".join(rng.choices("ab.c", k=60))
        want, at = [], 0
        while at < len(text):
            best = max((t for t in terms if text.startswith(t, at)), key=len, default="")
            want += [best] if best else []
            at += len(best) or 1
        assert re.findall(tm.trie_pattern(terms), text) == want
    assert not re.search(tm.trie_pattern([]), "anything") and not re.search(tm.trie_pattern([""]), "anything")


def test_replacement_in_one_pass(spark):
    rng = random.Random(2)
    terms = L.CHINESE_TERMS
    texts = ["大语言模型在蛋白质结构预测", "no Chinese  here stays  as is", "", None, "知识图谱补全 and 知识图谱", "中文  没有词", "  量子计算机  ", "联邦学习联邦"]
    texts += ["".join(rng.choice([*terms, "的", " ", "x"]) for _ in range(12)) for _ in range(60)]
    got = column(spark, texts, lambda t: tm.replaced(t, terms))
    assert got == [None if t is None else one_pass(t, terms) if re.search(tm.CJK, t) else t for t in texts]
    # where no translation holds a term, it equals replacing the longest first
    for text, mine in zip(texts, got, strict=True):
        if text and re.search(tm.CJK, text):
            out = text
            for t in sorted(terms, key=len, reverse=True):
                out = out.replace(t, f" {terms[t]} ")
            if any(t in text for t in terms) and mine == one_pass(text, terms) and len(re.findall(tm.trie_pattern(terms), text)) == sum(text.count(t) for t in terms):
                assert mine == " ".join(out.split())
    # a translation that holds a term is not translated again
    assert column(spark, ["a b"], lambda t: tm.replaced(t, {"a": "b", "b": "a"}, None)) == ["b a"]


def test_dictionary(spark):
    table = spark.createDataFrame([("x", "2"), ("x", "1"), ("", "3"), (None, "4"), ("y", None)], "t string, n string")
    assert tm.dictionary(table, "t", "n") == {"x": "1"}
    with pytest.raises(ValueError):
        tm.dictionary(spark.range(5).select(F.col("id").cast("string").alias("t"), F.lit("n").alias("n")), "t", "n", 4)


TEXTS = [
    "Large-language models and RAG for covid19", "tumour oncology batteries", "AI+deep learning", "deep+learning", "a biomedical natural language processing NLP tool",
    "vision language model; graph neural networks (GNNs)", "ragged aim", "", None, "sars cov 2 and transformer based qa system", "knowledge graph embeddings",
]


def test_concepts(spark):
    got = column(spark, TEXTS, lambda t: tm.concepts_of(sc.normal_keyword(t)))
    normal = column(spark, TEXTS, sc.normal_keyword)
    for text, found in zip(normal, got, strict=True):
        want = sorted(n for n, phrases in L.CONCEPT_PHRASES.items() if any(re.search(rf"\b{re.escape(p)}\b", text) for p in phrases))
        assert found == want
    assert "artificial intelligence" in got[2] and got[3] == [] and got[6] == []
    table = spark.createDataFrame([(p, n) for n, ps in L.CONCEPT_PHRASES.items() for p in ps], "phrase string, concept string")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for few in (100_000, 1):
        rows = tm.concept_rows(docs, "i", sc.normal_keyword(F.col("t")), table, range(1, 6), few).collect()
        assert sorted((r.doc, r.concept) for r in rows) == sorted((i, c) for i, cs in enumerate(got) for c in cs)


def test_filler_and_recency(spark):
    asked = ["给我一篇最新的计算机视觉论文", "Please recommend a paper on recommender systems", "list", "latest", "请", "what are GANs", "listed items", None]
    assert column(spark, asked, tm.without_filler) == ["计算机视觉", "recommender systems", "list", "latest", "请", "GANs", "listed items", None]
    assert column(spark, asked, tm.wants_recent) == [True, False, False, True, False, False, False, False]
    assert column(spark, asked, tm.has_chinese) == [True, False, False, False, True, False, False, False]


def test_taxonomy(spark):
    shape = "i int, source string, topic struct<name: string, domain: string, field: string, subfield: string>, cats array<string>, subjects array<string>, mesh array<string>, seed string, field string, keywords array<string>"
    rows = [
        (0, "openalex", ("T", " Life ", "Bio", ""), None, None, None, "medicine", "x", ["Study", "Gene  editing"]),
        (1, "openalex", None, None, None, None, "Public health", "x", []),
        (2, "arxiv", None, ["cs.CL", "cs.AI"], None, None, None, None, None),
        (3, "arxiv", None, ["cs.ZZ"], None, None, None, None, None),
        (4, "arxiv", None, [], None, None, None, None, ["optics"]),
        (5, "doaj", None, None, ["Poetry", "Political science"], None, "law", None, None),
        (6, "doaj", None, None, [], None, "Chemical technology", None, None),
        (7, "pubmed", None, None, None, ["Humans", "Heart Diseases"], "poetry", None, None),
        (8, "pmc", None, None, None, None, "computer", None, None),
        (9, "core", None, None, None, None, None, "economics of law", ["abc", "method"]),
        (10, None, None, None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, shape)
    taxon = tm.taxonomy(*[F.col(c) for c in ("source", "topic", "cats", "subjects", "mesh", "seed", "field", "keywords")])
    got = {r.i: (r.t.domain, r.t.field, r.t.subfield, r.t.taxonomy_source, r.t.taxonomy_confidence, r.t.raw_taxonomy_terms) for r in frame.select("i", taxon.alias("t")).collect()}
    assert got == {
        0: ("Life", "Bio", "gene editing", "openalex_primary_topic", 0.95, "T;Life;Bio"),
        1: ("Health Sciences", "Medicine", "Public health", "openalex_primary_topic", 0.55, ""),
        2: ("Computer Science", "Artificial Intelligence", "Natural Language Processing", "arxiv_category", 0.9, "cs.CL;cs.AI"),
        3: ("Computer Science", "Computer Science", "cs.ZZ", "arxiv_category", 0.9, "cs.ZZ"),
        4: ("Physical Sciences", "Physics", "optic", "arxiv_category", 0.55, ""),
        5: ("Physical Sciences", "Physical Sciences", "Poetry", "doaj_subject", 0.82, "Poetry;Political science"),
        6: ("Physical Sciences", "Materials Science", "Chemical technology", "doaj_subject", 0.55, ""),
        7: ("Health Sciences", "Medicine", "human", "biomedical_keywords", 0.75, "Humans;Heart Diseases"),
        8: ("Computer Science", "Computer Science", "", "biomedical_keywords", 0.6, ""),
        9: ("Social Sciences", "Social Sciences", "economics of law", "field_seed", 0.55, "economics of law"),
        10: ("Cross-field", "Unknown", "", "field_seed", 0.55, ""),
    }


def plain_evidence(papers, question, special):
    words = re.findall("[a-z0-9]+", question.lower())
    phrases = {" ".join(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1)}
    out = {}
    for doc, fields in papers.items():
        score, hits = 0, {"special": set(), "phrase": set(), "term": set()}
        for name, text in fields.items():
            weight, times = L.FIELD_WEIGHTS[name]
            plain = " ".join(re.findall("[a-z0-9]+", (text or "").lower()))
            has = lambda p, plain=plain: f" {p} " in f" {plain} "
            for kind, wanted, factor in (("term", set(words), 1), ("phrase", phrases, times), ("special", {special[w] for w in words if w in special}, 2 * times)):
                found = {p for p in wanted if has(p)}
                hits[kind] |= found
                score += len(found) * weight * factor
        if score:
            out[doc] = (score, [*sorted(hits["special"]), *sorted(hits["phrase"]), *sorted(hits["term"])])
    return out


def test_evidence(spark):
    papers = {
        1: {"title": "Retrieval Augmented Generation for science", "keywords": "rag", "abstract": "x", "full_text": None},
        2: {"title": "Generation of retrieval, augmented", "keywords": "", "abstract": "graph of knowledge", "full_text": "knowledge graph knowledge graph"},
        3: {"title": "knowledge-graph reasoning", "keywords": "graph", "abstract": "the knowledge graph", "full_text": "a"},
        4: {"title": "nothing", "keywords": None, "abstract": "", "full_text": "ragged graphs"},
    }
    questions = [(1, "What is RAG?"), (2, "knowledge graph reasoning"), (3, ""), (4, None), (5, "the the")]
    names = list(L.FIELD_WEIGHTS)
    docs = spark.createDataFrame([(d, *[f[n] for n in names]) for d, f in papers.items()], "doc long, " + ", ".join(f"{n} string" for n in names))
    rows = ev.evidence_scores(docs, "doc", {n: F.col(n) for n in names}, spark.createDataFrame(questions, "q long, t string"), "q", "t").collect()
    want = {(q, d): v for q, t in questions for d, v in plain_evidence(papers, t or "", L.SPECIAL_PHRASES).items()}
    assert {(r.query, r.doc): (r.score, r.matches) for r in rows} == want
    best = {(r.query, r["rank"]): r.doc for r in ev.best_evidence(spark.createDataFrame(rows)).collect()}
    # the phrase beats the same words scattered, and an abbreviation finds what it stands for
    assert best[1, 1] == 1 and best[2, 1] == 3 and want[2, 3][0] > want[2, 2][0] > 0
    empty = docs.limit(0)
    assert ev.evidence_scores(empty, "doc", {n: F.col(n) for n in names}, spark.createDataFrame(questions, "q long, t string"), "q", "t").count() == 0


def test_positions(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, ""), (3, None)], "doc long, t string")
    got = {r.gram: r.positions for r in ev.positional_postings(docs, "doc", {"t": F.col("t")}, (1, 2)).collect()}
    assert got == {"a": [0, 2], "b": [1, 3], "c": [4], "a b": [0, 2], "b a": [1], "b c": [3]}
