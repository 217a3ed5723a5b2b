"""Spans that agree in the upper 32 bits of their hashes are still different passages."""

from __future__ import annotations

from lodestack.llm.substring import remove_repeats

LINE = "w550820 w610511 w186986 w602719 w566001 "
ONE = LINE + "v27983 v55379 v31785 v11946 v86014 v68097 v58967 v32108 v50533 v64000 v97418 v3740 v60636 v36380 v99735"
TWO = LINE + "v84372 v87214 v64362 v5922 v56056 v99684 v60578 v69013 v13019 v70360 v66474 v8814 v46650 v11540 v30277"


def test_spans_of_one_anchor_with_equal_upper_bits(spark):
    docs = spark.createDataFrame([(1, ONE), (2, TWO), (3, TWO)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs, batches=1).collect()} == {1: 0, 2: 0, 3: 20}
