"""Removal of repeated passages with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document. Among the ``CORE``-word runs inside a
window the one of least hash is its anchor (the leftmost of equal ones), so equal windows have
equal anchors at equal places. Neighbouring windows mostly share an anchor; the words of all
windows that share one are its *span*. One fingerprint row, (anchor hash, span hash, 64 bits each of
different functions), thus stands for about eight windows.

The index is a list of immutable runs (see ``runs``): tables bucketed and sorted by anchor and span, with a row for
each fingerprint and the first place that has it. A new batch of documents, later than all batches before, is dealt out once
by anchor; its run and its places have the same buckets, so they are merge-joined with each old run bucket by bucket: old
runs are read, not dealt out again.

* A place whose whole span (128 bits with its anchor) an earlier document has makes all its windows repeats.
* Where an anchor occurs with different spans, the first document of each span is read again and
  its windows are compared one by one on 128-bit window hashes (the verification).
* Windows that repeat inside one document are found when the document is cut.

The batch's run then joins the index, and when ``FANOUT`` runs of a level exist they are compacted into
one of the next level. The runs are listed in a manifest in the shared folder: a later session reopens the index by its
path and feeds it the next batch, with the documents of earlier batches as ``history``.

Documents must carry ids that ascend over batches: "earlier" means a smaller id, or the same
document further left. Null text has no words. Rows with a null id take no part in comparisons
between documents; only their own inner repeats are removed. Rows of one id never are earlier than each other: each loses
what smaller ids have and what it repeats itself, whether their texts are equal or not. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, stage
from . import kernel as K
from .runs import RunStore, by_bucket

WINDOW = 20
CORE = 5
FANOUT = 4
_SLICE = 1 << 19
#: Most bits of the filters that spare rows without a partner from a shuffle (4 MB each), and bits for each member.
FILTER_BITS = 1 << 25
BITS_EACH = 8


@dataclass
class _Fingerprints:
    """Of one slice: word data, and for every run of windows with one anchor its hashes and range."""

    words: K.Words
    sums: tuple[np.ndarray, np.ndarray]
    anchor: np.ndarray
    span: np.ndarray
    low: np.ndarray  # first window of the run (word number in the slice)
    high: np.ndarray  # last window of the run


def _fingerprints(text: K.Text, window: int, core: int) -> _Fingerprints:
    w = K.words(text)
    hashes = [K.range_hashes(text.data, w.start, w.end, k) for k in (0, 1)]
    sums = tuple(K.sums_of(h, k) for k, h in enumerate(hashes))
    at = K.window_starts(w, window)
    width = window - core + 1
    if not len(at):
        none = np.zeros(0, np.int64)
        return _Fingerprints(w, sums, none.view(np.uint64), none.view(np.uint64), none, none)
    every = np.arange(len(w) - core + 1)
    cores = K.span_hashes(sums[0], every, every + core)
    least = cores[at]
    where = at.copy()
    for step in range(1, width):
        here = cores[at + step]
        less = here < least
        least = np.where(less, here, least)
        where = np.where(less, at + step, where)
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    low, high = at[begin], at[np.append(begin[1:], len(at)) - 1]
    span = K.span_hashes(sums[1], low, high + window, 1) + K.mix((where[begin] - low).astype(np.uint64))
    return _Fingerprints(w, sums, least[begin], K.mix(span), low, high)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.int64, copy=False) if x.dtype != np.uint64 else x.view(np.int64))


_KEY = ["doc_id", "version"]
_PLACE = "doc_id long, version int, low int, high int"


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, version, text``: the version, a hash, tells different texts of one id apart."""
    return docs.select("doc_id", F.hash("text").alias("version"), "text")


def _occurrences(window: int, core: int):
    def run(batches):
        for batch in batches:
            for text in K.slices(batch.column(2), _SLICE):
                f = _fingerprints(text, window, core)
                doc = f.words.doc[f.low]
                begin, row = f.words.first[doc], pa.array(doc + text.first)
                keys = [batch.column(k).take(row) for k in (0, 1)]
                places = [pa.array((x - begin).astype(np.int32)) for x in (f.low, f.high)]
                yield pa.RecordBatch.from_arrays([_long(f.anchor), _long(f.span), *keys, *places], names=["anchor", "span", *_KEY, "low", "high"])

    return run


def _own_ranges(lists: pa.Array, row: int, words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last windows of a row's ranges. Rows with one key have one text, but for a hash collision; ranges
    beyond the row's words are left out."""
    low, high = (x.to_numpy().astype(np.int64) for x in lists[row].values.flatten())
    inside = high + window <= words
    return low[inside], high[inside]


def _window_hashes(window: int):
    """doc_id, version, text, ranges of windows -> one row for each of those windows."""

    def run(batches):
        for batch in batches:
            for text in K.slices(batch.column(2), _SLICE):
                w = K.words(text)
                sums = [K.sums_of(K.range_hashes(text.data, w.start, w.end, k), k) for k in (0, 1)]
                at, doc = [], []
                for i in range(len(text)):
                    low, high = _own_ranges(batch.column(3), text.first + i, w.first[i + 1] - w.first[i], window)
                    size = high - low + 1
                    own = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    at.append(own + w.first[i])
                    doc.append(np.full(len(own), i))
                at, doc = np.concatenate(at), np.concatenate(doc)
                hashes = [_long(K.span_hashes(sums[k], at, at + window, k)) for k in (0, 1)]
                keys = [batch.column(k).take(pa.array(doc + text.first)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*hashes, *keys, pa.array((at - w.first[doc]).astype(np.int32))], names=["hash_a", "hash_b", *_KEY, "low"])

    return run


def _inner_repeats(w: K.Words, sums, window: int) -> np.ndarray:
    """Windows whose words occur further left in the same document."""
    at = K.window_starts(w, window)
    a = K.span_hashes(sums[0], at, at + window)
    order = np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    if not same.any():
        return at[:0]
    group = np.concatenate([[0], np.cumsum(~same)])
    keep = np.zeros(len(order), bool)
    keep[1:] |= same
    keep[:-1] |= same
    order, group = order[keep], group[keep]
    b = K.span_hashes(sums[1], at[order], at[order] + window, 1)
    doc = w.doc[at[order]]
    by = np.lexsort((order, b, doc, group))
    again = (group[by][1:] == group[by][:-1]) & (doc[by][1:] == doc[by][:-1]) & (b[by][1:] == b[by][:-1])
    return at[order[by][1:][again]]


def _cleaned(window: int, keep_text: bool):
    """doc_id, version, text and, if any, ranges of repeated windows -> the document without the words they cover."""

    def run(batches):
        for batch in batches:
            has_ranges = batch.num_columns > 3
            for text in K.slices(batch.column(2), _SLICE):
                w = K.words(text)
                sums = [K.sums_of(K.range_hashes(text.data, w.start, w.end, k), k) for k in (0, 1)]
                cover = np.zeros(len(w) + 1, np.int64)
                inner = _inner_repeats(w, sums, window)
                np.add.at(cover, inner, 1)
                np.add.at(cover, inner + window, -1)
                if has_ranges:
                    for i in range(len(text)):
                        if batch.column(3)[text.first + i].is_valid:
                            low, high = _own_ranges(batch.column(3), text.first + i, w.first[i + 1] - w.first[i], window)
                            np.add.at(cover, low + w.first[i], 1)
                            np.add.at(cover, high + w.first[i] + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed = K.per_doc(gone, w.first)
                raw, digests, texts = text.data.tobytes(), [], []
                for i in range(len(text)):
                    own = raw[text.offsets[i] : text.offsets[i + 1]].split()
                    if removed[i]:
                        flags = gone[w.first[i] : w.first[i + 1]]
                        own = [x for x, out in zip(own, flags.tolist(), strict=True) if not out]
                    kept = b" ".join(own)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        texts.append(kept.decode())
                columns = [batch.column(0).slice(text.first, len(text)), _long(np.diff(w.first)), _long(removed), pa.array(digests, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array(texts, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _bitmap(bits: int):
    def run(batches):
        seen = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            slot = _slots(batch.column(0), bits)
            np.bitwise_or.at(seen, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), _long(seen[at])], names=["slot", "bits"])

    return run


def _slots(hashes: pa.Array, bits: int) -> np.ndarray:
    return np.asarray(hashes).astype(np.int64).view(np.uint64) & np.uint64(bits - 1)


def _maybe(table: DataFrame, members: DataFrame, *keys: str):
    """A condition on rows of ``table``: certainly true where ``members`` (staged) has the same keys, mostly false elsewhere.

    A bitmap for all members is gathered and broadcast, so that a join with ``members`` shuffles little of
    ``table``. With more members than it has room for, nothing is gathered and all rows pass.
    """
    n = members.count()
    bits = max(1 << 10, 1 << (BITS_EACH * max(n, 1) - 1).bit_length())
    if bits > FILTER_BITS:
        return F.lit(True)
    words = np.zeros(bits // 64, np.uint64)
    hashed = members.select(F.xxhash64(*keys).alias("h"))
    rows = hashed.mapInArrow(_bitmap(bits), "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()
    words[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    shared = table.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def maybe(column: pa.Array) -> pa.Array:
        slot = _slots(column, bits)
        return pa.array((shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1)

    return maybe(F.xxhash64(*keys))


def _merged(tables: list[DataFrame]) -> DataFrame:
    """One row for each fingerprint, with its first place."""
    grouped = reduce(DataFrame.union, tables).groupBy("anchor", "span").agg(F.min(F.struct(*_KEY, "low", "high")).alias("p"))
    return grouped.select("anchor", "span", "p.*")


class FingerprintIndex:
    """Sorted runs of the batches absorbed so far; ``path`` names an index to reopen or begin."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, core: int = CORE, fanout: int = FANOUT, buckets: int = 0, path: str | None = None):
        self.spark, self.window, self.core = spark, window, core
        self.store = RunStore(spark, path, fanout=fanout, buckets=buckets)

    @property
    def runs(self) -> list[str]:
        """Names of the tables."""
        return [r.name for r in self.store.runs]

    def close(self) -> None:
        """Forget the session's tables; the index can be reopened by its path."""
        self.store.close()

    def touched(self, fresh: DataFrame) -> list[DataFrame]:
        """Of each run the rows whose anchor ``fresh``, a run, has: a merge join of equal buckets."""
        return [old.join(fresh.select("anchor").hint("merge"), "anchor", "left_semi") for old in self.store.tables]

    def absorb(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Ranges of repeated windows in ``docs`` (``doc_id, version, low, high`` in window numbers), staged.

        ``docs`` and ``history`` (all documents of earlier batches) have ``doc_id`` and ``text``. The
        index afterwards holds the batch too. Repeats inside one document are not listed.
        """
        store, given = self.store, _keyed(docs)
        seen = store.write(given.where("doc_id is not null").mapInArrow(_occurrences(self.window, self.core), "anchor long, span long, " + _PLACE))
        places = store.table(seen)
        with by_bucket(self.spark):
            run = store.write(_merged([places]), dealt=True)
            fresh, touched = store.table(run), self.touched(store.table(run))
            ranked = places.withColumn("first", F.min("doc_id").over(Window.partitionBy("anchor", "span")))
            found = [stage(ranked.where("doc_id > first").select(*_KEY, "low", "high"), "repeats")]
            for old in store.tables:
                earlier = places.join(old.select("anchor", "span", F.col("doc_id").alias("first")).hint("merge"), ["anchor", "span"]).where("doc_id > first")
                found.append(stage(earlier.select(*_KEY, "low", "high"), "repeats"))
            known = _merged([fresh, *touched]) if touched else fresh
            mixed = stage(known.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1").select("anchor"), "mixed")
            # the first document of each span of an anchor with several spans is read again
            lead = ranked.where("doc_id = first").join(mixed, "anchor", "left_semi")
            for old in store.tables:
                lead = lead.join(old.select("anchor", "span").hint("merge"), ["anchor", "span"], "left_anti")
            mine = stage(lead.select(*_KEY, "low", "high"), "leaders")
            windows = [stage(self._windows(given, mine), "windows")]
            staged = [mixed, mine, *windows]
            if touched and history is not None:
                theirs = stage(reduce(DataFrame.union, touched).join(mixed, "anchor", "left_semi").select(*_KEY, "low", "high"), "leaders")
                windows.append(stage(self._windows(_keyed(history), theirs), "windows"))
                staged += [theirs, windows[-1]]
        every = reduce(DataFrame.union, windows)
        least = every.groupBy("hash_a", "hash_b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        single = windows[0].join(least, ["hash_a", "hash_b"]).where("doc_id > first").select(*_KEY, "low", F.col("low").alias("high"))
        out = stage(reduce(DataFrame.union, [*found, single]), "repeats")
        store.drop(seen)
        store.add(run, _merged)
        for table in (*staged, *found):
            discard(table)
        return out

    def _windows(self, docs: DataFrame, ranges: DataFrame) -> DataFrame:
        lists = ranges.groupBy(*_KEY).agg(F.collect_list(F.struct("low", "high")).alias("r"))
        read = docs.where(_maybe(docs, ranges, *_KEY)).join(lists, _KEY).select(*_KEY, "text", "r")
        return read.mapInArrow(_window_hashes(self.window), "hash_a long, hash_b long, doc_id long, version int, low int")


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2, window: int = WINDOW, core: int = CORE, keep_text: bool = False
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) for every row of ``docs``.

    The table is fed to a new index in ``batches`` id ranges, as if it had arrived so.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    index = FingerprintIndex(spark, window, core)
    cuts = given.where("doc_id is not null").agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("c")).first().c if batches > 1 else []
    cuts = sorted(set(cuts or []))
    bounds = [None, *cuts, None]
    found = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = given
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        found.append(index.absorb(part, given.where(F.col("doc_id") <= low) if low is not None else None))
    index.store.delete()
    rows = _keyed(given)
    lists = stage(reduce(DataFrame.union, found).groupBy(*_KEY).agg(F.collect_set(F.struct("low", "high")).alias("r")), "ranges")
    for part in found:
        discard(part)
    hit = _maybe(rows, lists, *_KEY)
    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    clean = rows.where(~hit).mapInArrow(_cleaned(window, keep_text), shape)
    cut = rows.where(hit).join(lists, _KEY, "left").select(*_KEY, "text", "r").mapInArrow(_cleaned(window, keep_text), shape)
    return clean.union(cut)
