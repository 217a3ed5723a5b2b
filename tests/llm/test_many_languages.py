"""Hundreds of languages, and texts longer than what is weighed at once."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lodestack.llm import kernel as K
from lodestack.llm import langid
from lodestack.llm.langid import LanguageModel, codewords
from lodestack.llm.quality import QualityRules


def language(k):
    """Words of a language of its own letters."""
    rng = random.Random(k)
    letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 7)
    return ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(60)]


def text(k, n, seed):
    return " ".join(random.Random(seed).choices(language(k), k=n))


def test_codewords_stay_apart():
    code = codewords(300)
    gaps = (code.shape[1] - (code @ code.T)[np.triu_indices(300, 1)]) / 2
    assert gaps.min() >= 8 and len({tuple(c) for c in code}) == 300


def test_three_hundred_languages(spark):
    rows = [(k * 10 + i, text(k, 80, k * 10 + i), f"l{k:03}") for k in range(300) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = LanguageModel.fit(docs)
    assert len(model.langs) == 300
    fresh = spark.createDataFrame([(k, text(k, 200, 9_000 + k)) for k in range(0, 300, 3)], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in model.predict(fresh).collect()}
    assert sum(found[k] == f"l{k:03}" for k in found) >= 90
    rules = QualityRules.fit(docs)
    assert len(rules.langs) == 300
    kept = {r.doc_id: (r.kept, r.word_distance) for r in rules.apply(fresh).collect()}
    assert all(np.isfinite(d) for _, d in kept.values()) and sum(k for k, _ in kept.values()) >= 80


def test_long_texts_in_parts(spark, monkeypatch):
    """Parts of a text add up to the whole."""
    docs = spark.createDataFrame([(k, text(k, 300, k), f"l{k}") for k in range(5)], "doc_id long, text string, lang string")
    model = LanguageModel.fit(docs)
    column = pa.array([text(1, 4000, 5) + " é東", "short", "", None, "12 " * 3000 + "ö"])
    whole = model._predict(column)
    monkeypatch.setattr(langid, "_PART", 1000)
    parts = model._predict(column)
    assert whole.field("lang_pred").to_pylist() == parts.field("lang_pred").to_pylist()
    for name in ("score", "distance"):
        assert np.allclose(whole.field(name).to_numpy(), parts.field(name).to_numpy(), atol=1e-9)
    counted = [dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) for b in langid._count([pa.RecordBatch.from_arrays([column.slice(0, 1), pa.array(["x"])], names=["text", "lang"])])]
    monkeypatch.setattr(langid, "_PART", 1 << 20)
    again = [dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) for b in langid._count([pa.RecordBatch.from_arrays([column.slice(0, 1), pa.array(["x"])], names=["text", "lang"])])]
    assert counted == again
    one = K.Text(np.frombuffer(b"abcdefg", np.uint8), np.array([0, 7]), 0)
    assert [(bytes(t.data), n) for t, n in K.parts(one, 3, 2)] == [(b"abcde", 3), (b"defg", 3), (b"g", 1)]
