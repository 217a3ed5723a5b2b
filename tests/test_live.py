"""Streams killed and run again, views that touch only what changed, line numbers, and counts of a normalise job."""

from __future__ import annotations

import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestack.operators import dedupe, normalize
from lodestack.operators.textstats import hashed_vectors
from lodestack.sources import records
from lodestack.streaming import jobs, live


def feed(spark, folder, rows, schema):
    """One more file in a folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


STANCES = "claim string, paper string, stance string, seen long"


def batches():
    return [
        [("c1", "p1", "SUPPORT", 1), ("c1", "p2", "CONTRADICT", 2), ("c2", "p1", "SUPPORT", 3), ("c3", "p9", None, 1)],
        [("c1", "p2", "SUPPORT", 4), ("c2", "p3", "CONTRADICT", 5)],  # c1 is no longer disputed, c2 is
        [("c1", "p2", "CONTRADICT", 3), ("c2", "p3", "NEUTRAL", 6), ("c2", "p3", "CONTRADICT", 7)],  # the first is out of date
        [("c1", "p1", "CONTRADICT", 9), ("c1", "p2", "SUPPORT", 9), (None, "p", "SUPPORT", 9)],
    ]


def plain_view(rows):
    held = {}
    for claim, paper, stance, seen in rows:
        if claim is not None and stance is not None and seen >= held.get((claim, paper), ("", 0))[1]:
            held[claim, paper] = stance, seen
    out = defaultdict(lambda: [0, 0, 0, 0])
    for (claim, _), (stance, seen) in held.items():
        v = out[claim]
        out[claim] = [v[0] + (stance == "SUPPORT"), v[1] + (stance == "CONTRADICT"), v[2] + 1, max(v[3], seen)]
    return {c: tuple(v) for c, v in out.items()}


def view_rows(frame):
    return {r.claim: (r.support, r.contradict, r.papers, r.last_seen) for r in frame.collect()}


def test_contradictions_after_every_batch(spark, tmp_path):
    folder, path, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    for rows in batches():
        feed(spark, folder, rows, STANCES)
        seen += rows
        view = live.live_contradictions(spark, jobs.stream(spark, folder, 1), path)
        assert view_rows(view.table()) == plain_view(seen)
        want = {c for c, v in plain_view(seen).items() if v[0] and v[1]}
        assert {r.claim for r in live.disputed(view.table()).collect()} == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    view = live.BucketedView(spark, str(tmp_path / "v"), "k long, n long", "k", ("n",), (), 8)
    view.add(spark.range(40).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")), 0)
    touched = view.add(spark.createDataFrame([(3, 5)], "k long, n long"), 1)
    assert len(touched) == 1 and {b for b, v in view._versions().items() if 1 in v} == touched
    assert {r.k: r.n for r in view.table().collect()} == {k: 6 if k == 3 else 1 for k in range(40)}
    view.add(spark.createDataFrame([(3, 5)], "k long, n long"), 1)  # the same batch again
    assert {r.k: r.n for r in view.table().collect()}[3] == 6
    assert view.add(spark.createDataFrame([], "k long, n long"), 2) == set()


@pytest.mark.parametrize("when", ["before", "after"])
def test_contradictions_of_a_killed_stream(spark, tmp_path, when):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches():
        feed(spark, folder, rows, STANCES)

    def die(number):
        if number == 1:
            raise RuntimeError("killed")

    if when == "after":
        with pytest.raises(Exception, match="killed"):
            live.live_contradictions(spark, jobs.stream(spark, folder, 1), path, die)
    view = live.live_contradictions(spark, jobs.stream(spark, folder, 1), path)
    # micro-batches follow the files' times; the newest row of each paper counts whatever their order
    assert view_rows(view.table()) == plain_view([r for rows in batches() for r in rows])


def test_vectors_of_a_killed_stream(spark, tmp_path):
    folder, path, encoded = str(tmp_path / "in"), str(tmp_path / "out"), []
    for n in range(4):
        feed(spark, folder, [(i, f"text {i}") for i in range(10 * n, 10 * n + 12)], "chunk long, text string")  # two of each file come again in the next
    encode = lambda rows: hashed_vectors(rows, "chunk", "text", 16).withColumnRenamed("doc", "chunk")
    stream = lambda: jobs.stream(spark, folder, 1)

    def die(number):
        encoded.append(number)
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        live.resumable_vectors(spark, stream(), path, "m1", encode, after_batch=die)
    done = live.resumable_vectors(spark, stream(), path, "m1", encode)
    assert Counter(r.chunk for r in done.collect()) == Counter(range(42)) and encoded == [0, 1, 2]
    again = live.resumable_vectors(spark, stream(), path, "m1", encode, str(tmp_path / "other"))
    assert Counter(r.chunk for r in again.collect()) == Counter(range(42))
    still = live.resumable_vectors(spark, stream(), path, "m1", encode)  # nothing new at all
    assert Counter(r.chunk for r in still.select("chunk").collect()) == Counter(range(42))
    other = live.resumable_vectors(spark, stream(), path, "m2", encode)
    assert other.count() == 42


def test_line_numbers_hold_however_files_are_split(spark, tmp_path):
    for name, n in (("a", 700), ("b", 1), ("c", 0)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"source": "core", "source_id": f"{name}{i}", "raw": {"id": i}}) + "\n" + "\n" * (i % 3 == 0) for i in range(n)))
    numbers = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4k", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = records.read_wrappers(spark, str(tmp_path))
            numbers.append(sorted((r.raw_file[-7:], r.line_order, r.source_id) for r in rows.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    lines = (tmp_path / "a.jsonl").read_text().split("\n")
    want = sorted(("a.jsonl", i, json.loads(x)["source_id"]) for i, x in enumerate(lines, 1) if x)
    assert numbers[0] == numbers[1] == numbers[2] and [x for x in numbers[0] if x[0] == "a.jsonl"] == want


def test_normalize_job_counts(spark, tmp_path):
    raws = [("core", {"id": "1", "title": "A"}), ("core", {"id": "1", "title": "B"}), ("core", {"title": "T", "yearPublished": 2020}), ("core", {"title": "T", "yearPublished": 2020}), ("what", {"id": "9"}), ("core", {})]
    lines = [json.dumps({"source": s, "source_id": str(i), "raw": r}) for i, (s, r) in enumerate(raws)] + ["not json"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n\n")
    counts = normalize.normalize_job(records.read_wrappers(spark, str(tmp_path)), str(tmp_path / "out"))
    papers = spark.read.parquet(str(tmp_path / "out"))
    assert counts == {"input": 7, "output": 2, "duplicates": 2, "invalid": 3}
    assert sorted((r.paper_id or "", r.title) for r in papers.collect()) == [("", "T"), ("1", "A")]


def test_author_entries(spark):
    raw = json.dumps({"authorships": [
        {"author": {"id": "A1", "display_name": "Ann Lee", "orcid": "0"}, "institutions": [{"id": "I", "display_name": "Uni", "country_code": "FR"}], "author_position": "first"},
        {"author": {"display_name": "Bo  Ek", "orcid": "77"}}, {"author": {"display_name": "Cé-C"}}, {"author": {"display_name": ""}},
    ]})
    rows = [(1, raw, ["Not Used"]), (2, "{}", [" Dan O'Hara ", "", "  ", "東京"]), (3, None, None)]
    frame = spark.createDataFrame(rows, "i int, raw string, names array<string>")
    got = {r.i: r.e for r in frame.select("i", normalize.author_entries(normalize.authorships(F.col("raw")), F.col("names")).alias("e")).collect()}
    assert [(e.author_key, e.author, e.identity_source, e.author_position) for e in got[1]] == [("A1", "Ann Lee", "author_id", 1), ("77", "Bo  Ek", "orcid", 2), ("name:c c", "Cé-C", "name", 3)]
    assert got[1][0].institutions == ["Uni"] and got[1][0].country_codes == ["FR"]
    assert [(e.author_key, e.author, e.author_position, e.institutions) for e in got[2]] == [("name:dan o hara", "Dan O'Hara", 1, [])] and got[3] == []


def test_summary_records(spark):
    rows = [
        (1, ("77", "T", "2019 Jan", "J", [("pmc", "PMC5"), ("doi", " 10.1/x "), ("pmc", "6")], [("A B",), (None,)])), (2, ("78", None, None, None, None, None)),
        (3, ("79", "U", "sometime 1850, 2001", "K", [("pmcid", ""), ("PMCID", "81")], [])),
    ]
    frame = spark.createDataFrame(rows, f"i int, r {normalize.SUMMARY}")
    got = {r.i: (r.s.source_id, json.loads(r.s.raw)) for r in frame.select("i", normalize.summary_records(F.col("r")).alias("s")).collect()}
    assert got[1][0] == "PMC6" and got[1][1]["doi"] == "10.1/x" and got[1][1]["year"] == "2019" and got[1][1]["authors"] == ["A B", ""]
    assert got[2] == ("PMC78", {"pmcid": "PMC78", "title": "", "abstract": "", "authors": [], "year": "", "keywords": [""], "journal": "", "doi": "", "body_excerpt": ""})
    assert got[3][0] == "PMC81" and got[3][1]["year"] == "2001"


def test_best_of_a_hot_key(spark):
    """One key holds a third of all rows; each task passes on one row of it."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 7).alias("s"))
    best = dedupe.best_per_key(rows, ["k"], [F.col("s")], "id")
    assert best.where("k = 0").first() == (6, 0, 6) and best.count() == 20_001
    assert "Window" not in best._jdf.queryExecution().executedPlan().toString()
    nulls = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 5)], "id long, s long")
    assert dedupe.best_per_key(nulls, [F.lit(1)], [F.col("s")], "id").first().id == 2


def test_titles_far_by_length_are_far(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc ", k=rng.randint(0, 12))), "".join(rng.choices("abcd", k=rng.randint(0, 14)))) for _ in range(300)]
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", dedupe.far_by_length(F.col("a"), F.col("b"), 0.6).alias("far"))
    for r in frame.collect():
        if r.far:
            assert r.a not in r.b and r.b not in r.a and SequenceMatcher(None, r.a, r.b).ratio() < 0.6
