"""Ranked lexical search over posting lists in geometric blocks.

Each term's posting list is clustered by the similarity of its documents and cut into blocks of at most ``BLOCK``
documents. A block keeps a summary: for each term that items with this list ask for, the maximum of the block's
documents. An item's product with a summary is at least the score of every document of the block, so a block is
skipped only if that bound is below the item's threshold, and what is left is scored in full. Results are exact.

The steps are Spark jobs over tables in the shared folder:

1. *vectors*: each document's terms among those that the items ask for, with frequencies; corpus counts from these.
2. *thresholds*: documents of each item's rarest lists (``SEED`` postings or more) are scored; the k-th best score is
   the item's threshold. Lists whose greatest contributions together stay below it can't lift a document to the threshold
   alone; an item needs only its other lists, and a list that no item needs isn't built.
3. *slices*: documents are dealt out by ranges of a similarity key (signs of random projections) and a hash, so that no
   key, however frequent, makes a large partition; neighbours are packed into slices of at most ``SLICE_DOCS``. This is the
   forward index.
4. *blocks*: of every slice, each needed list's members are assigned to the nearest of some centres among them (shallow
   k-means) and cut into blocks.
5. *search*: blocks whose bound reaches the threshold name (item, document) pairs by slice, which are joined with the forward
   slices and scored. Only the best k of each item and slice go on.

The items' terms are broadcast, at most ``ASKED`` rows at once (or one item's); a larger item table is taken in several rounds.

A row of ``docs`` is a document of its own, repeated rows and ids too (equal scores and ids rank in any order, for their
result rows are equal); a null id sorts before others. Null text has no terms. Rows of one item id are one item, with
the terms of its distinct texts. Items without terms or matches have no rows; nor do tables without rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, stage
from . import kernel as K

BLOCK = 32
SLICE_DOCS = 2048
#: Cells of a slice's matrix of documents and terms.
CELLS = 1 << 22
SEED = 1000
ASKED = 1_000_000
#: Bits of the similarity key.
BITS = 16

_BREAKS = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _BREAKS[_low:_high] = False


def _terms(text: K.Text) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """A slice's terms, its lower-cased bytes, and the terms' 64-bit hashes."""
    w, data = K.words(text, _BREAKS), K.lowered(text.data)
    return w, data, K.range_hashes(data, w.start, w.end)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, text -> a row for each occurrence of a term, as two hashes."""
    for batch in batches:
        for text in K.slices(batch.column(1)):
            w, data, a = _terms(text)
            b = K.range_hashes(data, w.start, w.end, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.doc + text.first)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["item", "a", "b"])


@dataclass
class _Asked:
    """What the items of a round ask for; terms and items are numbered."""

    a: np.ndarray  # first hashes, ascending; a number is a place here
    b: np.ndarray
    first: np.ndarray  # where each item's terms begin (one more)
    term: np.ndarray  # ascending in each item
    times: np.ndarray
    weight: np.ndarray | None = None
    n_docs: int = 0
    length: int = 0
    theta: np.ndarray | None = None
    #: For each term the items that need its list.
    need_first: np.ndarray | None = None
    need: np.ndarray | None = None

    @property
    def terms(self) -> int:
        return len(self.a)

    def contributions(self, m: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Of postings, by their documents' m: what one occurrence in an item adds to its score."""
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """The documents' m."""
        return 25 + (75 * n * self.n_docs) // max(self.length, 1)

    def coordinates(self, term: int) -> np.ndarray:
        """The terms of all items that need this term's list."""
        items = self.need[self.need_first[term] : self.need_first[term + 1]]
        return np.unique(np.concatenate([self.term[self.first[i] : self.first[i + 1]] for i in items]))


def _spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places first[r] ... first[r+1]-1 of all ``rows``, and where each row's begin."""
    size = first[rows + 1] - first[rows]
    begin = np.cumsum(size) - size
    return np.repeat(first[rows] - begin, size) + np.arange(size.sum()), begin


def _products(asked: _Asked, first: np.ndarray, term: np.ndarray, value: np.ndarray, rows: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Of pairs of a row (a document or summary, as runs of ascending terms with values) and an item: their product."""
    have = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first)) * asked.terms + term
    out = np.zeros(len(rows), np.int64)
    if not len(have):
        return out
    for low in range(0, len(rows), 50_000):
        r, i = rows[low : low + 50_000], items[low : low + 50_000]
        at, begin = _spread(asked.first, i)
        want = np.repeat(r.astype(np.int64), np.diff(asked.first)[i]) * asked.terms + asked.term[at]
        place = np.minimum(np.searchsorted(have, want), len(have) - 1)
        out[low : low + 50_000] = np.add.reduceat(np.where(have[place] == want, value[place], 0) * asked.times[at], begin)
    return out


def _vectors(shared):
    """doc_id, text -> doc_id, n, term, tf."""

    def run(batches):
        asked = shared.value
        for batch in batches:
            for text in K.slices(batch.column(1)):
                w, data, a = _terms(text)
                at = np.minimum(np.searchsorted(asked.a, a), asked.terms - 1)
                known = np.flatnonzero(asked.a[at] == a)
                b = K.range_hashes(data, w.start[known], w.end[known], 1)
                known = known[asked.b[at[known]] == b]
                pair, tf = np.unique(w.doc[known] * asked.terms + at[known], return_counts=True)
                first = np.searchsorted(pair, np.arange(len(text) + 1) * asked.terms).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(v.astype(np.int32))) for v in (pair % asked.terms, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(text.first, len(text)), pa.array(np.diff(w.first)), *lists], names=["doc_id", "n", "term", "tf"])

    return run


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _first(column: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _postings(asked: _Asked, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a batch of vectors: m of each document, where its terms begin, terms, frequencies, contributions."""
    m, first = asked.lengths(batch.column(1).to_numpy()), _first(batch.column(2))
    term, tf = _flat(batch.column(2)).astype(np.int64), _flat(batch.column(3)).astype(np.int64)
    return m, first, term, tf, asked.contributions(np.repeat(m, np.diff(first)), term, tf)


def _thresholds(shared, seed_first: np.ndarray, seed_items: np.ndarray, k: int):
    """Vectors -> (kind 0, item, one of its best scores) and (kind 1, term, greatest contribution)."""

    def run(batches):
        asked = shared.value
        most = np.zeros(asked.terms, np.int64)
        best_item, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, first, term, _, value = _postings(asked, batch)
            np.maximum.at(most, term, value)
            hit = np.flatnonzero(np.diff(seed_first)[term])
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))[hit]
            at, _ = _spread(seed_first, term[hit])
            n_items = len(asked.first) - 1
            pair = np.unique(np.repeat(doc, np.diff(seed_first)[term[hit]]) * n_items + seed_items[at])
            score = _products(asked, first, term, value, pair // n_items, pair % n_items)
            best_item, best = np.concatenate([best_item, pair % n_items]), np.concatenate([best, score])
            keep = _leading(best_item, best, np.zeros(len(best), np.int64), k)
            best_item, best = best_item[keep], best[keep]
        seen = np.flatnonzero(most)
        kind = np.concatenate([np.zeros(len(best), np.int32), np.ones(len(seen), np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([best_item, seen])), pa.array(np.concatenate([best, most[seen]]))], names=["kind", "key", "value"])

    return run


def _leading(item: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's k greatest scores, equal ones by ascending ``tie``."""
    order = np.lexsort((tie, -score, item))
    ranked = item[order]
    return order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]


def _similarity(shared):
    """Vectors (with terms) with an integer that is alike for documents of like contributions."""

    def run(batches):
        asked = shared.value
        signs = np.random.Generator(np.random.PCG64(13)).choice(np.array([-1.0, 1.0], np.float32), (asked.terms, BITS))
        for batch in batches:
            _, first, term, _, value = _postings(asked, batch)
            bits = np.zeros((batch.num_rows, BITS), bool)
            for at in range(0, batch.num_rows, 256):
                begin = first[at : at + 257]
                own = slice(begin[0], begin[-1])
                bits[at : at + 256] = np.add.reduceat(value[own, None] * signs[term[own]], begin[:-1] - begin[0]) > 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((bits * (1 << np.arange(BITS - 1, -1, -1))).sum(1).astype(np.int32))], names=[*batch.schema.names, "near"])

    return run


def _slices(shared):
    """Vectors in similarity order -> packed slices ``slice, doc_id, m, first, term, tf``."""

    def run(batches):
        asked, number = shared.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            m, first, term, tf, _ = _postings(asked, batch)
            at = 0
            while at < batch.num_rows:
                to = min(at + SLICE_DOCS, batch.num_rows)
                while to - at > 1 and (to - at) * len(np.unique(term[first[at] : first[to]])) > CELLS:
                    to = (at + to) // 2
                own = slice(first[at], first[to])
                values = [batch.column(0).slice(at, to - at).to_pylist(), m[at:to], first[at : to + 1] - first[at], term[own], tf[own]]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                arrays = [pa.array([number]), *(pa.array([v], pa.list_(kind)) for v, kind in zip(values, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["slice", "doc_id", "m", "first", "term", "tf"])
                number, at = number + 1, to

    return run


_SLICES = "slice long, doc_id array<long>, m array<long>, first array<int>, term array<int>, tf array<int>"


def _unpacked(asked: _Asked, batch: pa.RecordBatch, row: int, at: int) -> tuple[np.ndarray, ...]:
    """Of a packed slice whose columns begin at ``at``: first, term, contribution, document."""
    m, first, term, tf = (batch.column(at + k)[row].values.to_numpy().astype(np.int64) for k in range(4))
    doc = np.repeat(np.arange(len(m)), np.diff(first))
    return first, term, asked.contributions(m[doc], term, tf), doc


def _clusters(rows: np.ndarray, unit: np.ndarray) -> Iterator[np.ndarray]:
    """``rows`` in blocks of at most ``BLOCK``: each with those nearest to the same centre."""
    if len(rows) <= BLOCK:
        yield rows
        return
    n = -(-len(rows) // BLOCK)
    centres = rows[np.arange(n) * len(rows) // n]
    nearest = np.argmax(unit[rows] @ unit[centres].T, axis=1)
    for c in np.unique(nearest):
        own = rows[nearest == c]
        for low in range(0, len(own), BLOCK):
            yield own[low : low + BLOCK]


def _blocks(shared):
    """Slices -> ``slice, term, members, coord, most``: each block of each needed list with its summary."""

    def run(batches):
        asked = shared.value
        coordinates: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column(0)[row].as_py()
                first, term, value, doc = _unpacked(asked, batch, row, 2)
                local, column = np.unique(term, return_inverse=True)
                cells = np.zeros((len(first) - 1, len(local)), np.int64)
                cells[doc, column] = value
                unit = cells.astype(np.float32)
                unit /= np.maximum(np.sqrt((unit * unit).sum(1, keepdims=True)), 1)
                out = [[] for _ in range(4)]
                for c in np.flatnonzero(np.diff(asked.need_first)[local]):
                    t = int(local[c])
                    if t not in coordinates:
                        coordinates[t] = asked.coordinates(t)
                    wanted = np.flatnonzero(np.isin(local, coordinates[t], assume_unique=True))
                    for members in _clusters(np.flatnonzero(cells[:, c]), unit):
                        most = cells[np.ix_(members, wanted)].max(axis=0)
                        some = np.flatnonzero(most)
                        for part, v in zip(out, (t, members, local[wanted[some]], most[some]), strict=True):
                            part.append(v)
                for low in range(0, len(out[0]), 4096):
                    t, members, coord, most = (part[low : low + 4096] for part in out)
                    lists = [pa.array(v, pa.list_(kind)) for v, kind in ((members, pa.int32()), (coord, pa.int32()), (most, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), number)), pa.array(t, pa.int32()), *lists], names=["slice", "term", "members", "coord", "most"])

    return run


_BLOCKS = "slice long, term int, members array<int>, coord array<int>, most array<long>"


def _reached(shared):
    """Blocks -> by slice the pairs of items and documents whose block's bound reaches the item's threshold."""

    def run(batches):
        asked = shared.value
        n_items = len(asked.first) - 1
        for batch in batches:
            term, first = batch.column(1).to_numpy().astype(np.int64), _first(batch.column(3))
            at, _ = _spread(asked.need_first, term)
            block, item = np.repeat(np.arange(len(term)), np.diff(asked.need_first)[term]), asked.need[at]
            bound = _products(asked, first, _flat(batch.column(3)).astype(np.int64), _flat(batch.column(4)), block, item)
            keep = (bound >= asked.theta[item]) & (bound > 0)
            block, item = block[keep], item[keep]
            begin, members = _first(batch.column(2)), _flat(batch.column(2)).astype(np.int64)
            at, _ = _spread(begin, block)
            item, member = np.repeat(item, np.diff(begin)[block]), members[at]
            number = np.repeat(batch.column(0).to_numpy()[block], np.diff(begin)[block])
            order = np.argsort(number, kind="stable")
            number, pair = number[order], (member * n_items + item)[order]
            cuts = np.flatnonzero(np.diff(number, prepend=-1))
            ends = np.append(cuts, len(pair))
            pairs = [np.unique(pair[low:high]) for low, high in zip(ends[:-1], ends[1:], strict=True)]
            lists = [pa.array([v // n_items for v in pairs], pa.list_(pa.int32())), pa.array([v % n_items for v in pairs], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(number[cuts]), *lists], names=["slice", "member", "item"])

    return run


def _scored(shared, k: int):
    """Pairs with their forward slice -> each item's best k documents of the slice that reach its threshold."""

    def run(batches):
        asked = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                member, item = (batch.column(c)[row].values.to_numpy().astype(np.int64) for c in (1, 2))
                first, term, value, _ = _unpacked(asked, batch, row, 4)
                score = _products(asked, first, term, value, member, item)
                good = np.flatnonzero((score >= asked.theta[item]) & (score > 0))
                ids = batch.column(3)[row].values.take(pa.array(member[good]))
                tie = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                keep = _leading(item[good], score[good], tie, k)
                good = good[keep]
                number = np.full(len(good), batch.column(0)[row].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item[good]), pa.array(number), pa.array(member[good]), ids.take(pa.array(keep)), pa.array(score[good])],
                    names=["key", "slice", "member", "doc_id", "score"],
                )

    return run


def _best(rows: DataFrame, key: str, k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def _needed(asked: _Asked, df: np.ndarray, most: np.ndarray) -> None:
    """Note which lists the items need, given the thresholds and each list's length and greatest contribution."""
    pairs = []
    for i, theta in enumerate(asked.theta):
        own = slice(asked.first[i], asked.first[i + 1])
        term = asked.term[own]
        bound = asked.times[own] * most[term]
        left, rest = 0, []
        for j in np.argsort(bound / np.maximum(df[term], 1), kind="stable"):
            if left + bound[j] < theta:
                left += bound[j]
            elif bound[j] > 0:
                rest.append(term[j])
        pairs.append(np.stack([np.array(rest, np.int64), np.full(len(rest), i)]))
    term, item = np.concatenate(pairs, axis=1)
    order = np.argsort(term, kind="stable")
    asked.need_first, asked.need = np.searchsorted(term[order], np.arange(asked.terms + 1)), item[order]


def _round(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The result for the items of ``rows`` (``item, a, b, times``), staged."""
    spark = docs.sparkSession
    got = rows.toArrow()
    ids = got["item"].combine_chunks().dictionary_encode(null_encoding="encode")
    names, item = ids.dictionary, ids.indices.to_numpy().astype(np.int64)
    a, b, times = (got[c].to_numpy() for c in ("a", "b", "times"))
    terms, term = np.unique(np.stack([a.view(np.uint64), b.view(np.uint64)]), axis=1, return_inverse=True)
    order = np.lexsort((term.reshape(-1), item))
    asked = _Asked(terms[0], terms[1], np.searchsorted(item[order], np.arange(len(names) + 1)), term.reshape(-1)[order], times[order])
    first_share = spark.sparkContext.broadcast(asked)
    vectors = stage(docs.mapInArrow(_vectors(first_share), "doc_id long, n long, term array<int>, tf array<int>"), "vectors")
    corpus = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counted = vectors.select(F.explode("term").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(asked.terms, np.int64)
    df[counted["term"].to_numpy()] = counted["count"].to_numpy()
    asked.n_docs, asked.length = corpus.docs, corpus.terms
    asked.weight = np.floor(1000 * np.log((2 * asked.n_docs + 2) / (2 * df + 1))).astype(np.int64)

    # the rarest lists of each item, SEED postings or more, for a first threshold
    seeds = []
    for i in range(len(names)):
        own = asked.term[asked.first[i] : asked.first[i + 1]]
        own = own[np.argsort(df[own], kind="stable")]
        seeds.append(own[: int(np.searchsorted(np.cumsum(df[own]), SEED)) + 1])
    seed_term = np.concatenate(seeds)
    by_term = np.argsort(seed_term, kind="stable")
    seed_items = np.repeat(np.arange(len(names)), [len(s) for s in seeds])[by_term]
    seed_first = np.searchsorted(seed_term[by_term], np.arange(asked.terms + 1))
    weighted = spark.sparkContext.broadcast(asked)
    tried = stage(vectors.where(F.size("term") > 0).mapInArrow(_thresholds(weighted, seed_first, seed_items, k), "kind int, key long, value long"), "thresholds")
    most = np.zeros(asked.terms, np.int64)
    for r in tried.where("kind = 1").groupBy("key").agg(F.max("value").alias("value")).collect():
        most[r.key] = r.value
    asked.theta = np.zeros(len(names), np.int64)
    for r in _best(tried.where("kind = 0"), "key", k, F.desc("value")).where(F.col("rank") == k).collect():
        asked.theta[r.key] = r.value
    _needed(asked, df, most)

    shared = spark.sparkContext.broadcast(asked)
    near = vectors.where(F.size("term") > 0).mapInArrow(_similarity(weighted), "doc_id long, n long, term array<int>, tf array<int>, near int")
    dealt = near.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "near", F.xxhash64("doc_id", "n")).sortWithinPartitions("near")
    forward = stage(dealt.drop("near").mapInArrow(_slices(shared), _SLICES), "forward")
    blocks = stage(forward.mapInArrow(_blocks(shared), _BLOCKS), "blocks")
    reached = blocks.mapInArrow(_reached(shared), "slice long, member array<int>, item array<int>")
    scored = reached.join(forward, "slice").select("slice", "member", "item", "doc_id", "m", "first", "term", "tf")
    # a pair can come from two lists of different batches
    rows = scored.mapInArrow(_scored(shared, k), "key long, slice long, member long, doc_id long, score long").dropDuplicates(["key", "slice", "member"])
    best = _best(rows, "key", k, F.desc("score"), F.asc_nulls_first("doc_id"))
    named = spark.createDataFrame(list(enumerate(names.to_pylist())), "key long, item_id long")
    out = stage(best.join(F.broadcast(named), "key").select("item_id", "rank", "doc_id", "score"), "ranked")
    for table in (vectors, tried, forward, blocks):
        discard(table)
    for share in (first_share, weighted, shared):
        share.unpersist()
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents above 0 of every item.

    Equal scores rank by ascending doc_id. See the README for the score.
    """
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    asking = items.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).distinct()
    rows = stage(asking.mapInArrow(_item_terms, "item long, a long, b long").groupBy("item", "a", "b").agg(F.count("*").alias("times")), "asked")
    rounds = -(-rows.count() // ASKED)
    if not rounds:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    parts = [rows.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r) if rounds > 1 else rows for r in range(rounds)]
    out = reduce(DataFrame.union, [_round(given, part, k) for part in parts if rounds == 1 or not part.isEmpty()])
    discard(rows)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS nn, CAST(sum(len(terms)) AS BIGINT) AS ll FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT k, doc_id, len(terms) AS n, term, count(*) AS tf FROM (SELECT k, doc_id, terms, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY k, doc_id, len(terms), term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, nn),
c AS (SELECT k, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) AS c FROM tf JOIN df ON df.term = tf.term CROSS JOIN s),
r AS (SELECT item_id, k, doc_id, CAST(sum(times * c) AS BIGINT) AS score FROM q JOIN c ON c.term = q.term GROUP BY item_id, k, doc_id HAVING sum(times * c) > 0),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r)
SELECT * FROM o WHERE rank <= 10
"""
