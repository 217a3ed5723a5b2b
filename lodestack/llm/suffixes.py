"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A *window* is ``WINDOW`` consecutive bytes of one document; a byte goes if a window over it has the same bytes as a window
that starts anywhere else. Suffixes are sampled by content: of the ``CORE``-byte strings inside a window the one of least
hash (leftmost of equal ones) is its anchor, so equal windows have their anchors at equal places, and each window is
reached from one sampled suffix. Neighbouring windows share an anchor; the bytes of all windows with one anchor are the
suffix's *span*, to which it is cut. About one byte in eighty begins a sampled suffix.

A batch's suffix array has one row for each different span, ordered by anchor and span (as 64-bit fingerprints of either, so
equal suffixes are neighbours), with one place where it occurs and whether there are more. It is a bucketed, sorted table
(see ``runs``). Existing levels are merge-scanned with it, bucket by bucket:

* a span that occurs more than once in batch and levels makes all its windows repeats, at its new places and at an
  old place that was alone so far;
* of an anchor with several spans one place of each span is read again. The spans' bytes are sorted as suffixes by
  prefix doubling, and windows that are neighbours with ``WINDOW`` bytes in common are repeats. Anchors with more than
  ``GROUP`` spans are refined by halves instead (see ``_refined``), in joins that spread over all tasks.

A span that a task meets more than once is known to repeat: its places go straight to the result, and one row for all of
them to the array, so a string that fills much of the corpus makes a few rows a task.

Then the array joins the family; two arrays of one level are merged into one of the next, so n batches leave about log n
arrays. The family is listed in a manifest and can be reopened by its path.

Rows of one id with different texts are documents of their own; equal rows are copies of each other. Documents of a null
id take part like others. Null text is empty. Texts of fewer bytes than a window stay whole. Long documents are
fingerprinted in pieces of ``PIECE`` bytes, which cut spans but lose no window. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, stage
from . import kernel as K
from .runs import RunStore, by_bucket

WINDOW = 200
CORE = 40
FANOUT = 2
PIECE = 1 << 22
GROUP = 256
#: Bytes of spans that are sorted together.
SORTED = 1 << 20
NO_ID = -(1 << 63)

_U = np.uint64
_LOW = _U((1 << 32) - 1)
_KEY = ["doc_id", "version"]
_PLACE = "doc_id long, version int, low int, high int"


def _pieces(column: pa.Array, window: int) -> Iterator[tuple[K.Text, int]]:
    """Slices of the documents, and where a slice begins in its document: beyond 0 for parts of a long one."""
    for text in K.slices(column):
        n = len(text.data)
        if n <= PIECE + window:
            yield text, 0
            continue
        for at in range(0, n - window + 1, PIECE):
            data = text.data[at : at + PIECE + window - 1]
            yield K.Text(data, np.array([0, len(data)]), text.first), at


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    have, k = x, 1
    while 2 * k <= width:
        have = np.minimum(have[:-k], have[k:])
        k *= 2
    n = len(x) - width + 1
    return np.minimum(have[:n], have[width - k : width - k + n])


def _sampled(text: K.Text, window: int, core: int) -> tuple[np.ndarray, ...]:
    """Of a slice's sampled suffixes: document, first and last window and anchor's place (byte numbers in the slice), anchor, span."""
    n = len(text.data)
    doc = np.repeat(np.arange(len(text), dtype=np.int32), np.diff(text.offsets))
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :]) if n >= window else np.zeros(0, np.int64)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(_U), none.view(_U)
    sums = K.byte_sums(text.data)
    every = np.arange(n - core + 1)
    cores = K.hashes_between(sums, every, every + core)
    where = (_least((cores & ~_LOW) | every.astype(_U), window - core + 1)[at] & _LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    low, high, where = at[begin], at[np.append(begin[1:], len(at)) - 1], where[begin]
    span = K.range_hashes(text.data, low, high + window, 1)
    return doc[low], low, high, where, cores[where], K.mix(span + K.mix((where - low).astype(_U)))


def _combined(rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of suffixes (anchor, span, row of the batch, low, high): one of each span with n = 1 or, of several, 2; and all places of the latter."""
    order = np.lexsort((rows[1], rows[0]))
    rows = [x[order] for x in rows]
    first = np.ones(len(order), bool)
    first[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(order)))
    again = np.repeat(size > 1, size)
    return [*(x[begin] for x in rows), np.minimum(size, 2)], [x[again] for x in rows[2:]]


#: Suffixes that a task combines at once.
COMBINED = 1 << 19


def _suffixes(window: int, core: int):
    """doc_id, version, text -> a row for each different sampled suffix (n 1 or 2), and for each place that is known to repeat (n 0)."""

    def run(batches):
        for batch in batches:
            held: list[list[np.ndarray]] = []

            def flush(batch=batch, held=held):
                if not held:
                    return
                (anchor, span, row, low, high, n), known = _combined([np.concatenate(x) for x in zip(*held, strict=True)])
                held.clear()
                rows = pa.array(np.concatenate([row, known[0]]))
                keys = [batch.column(k).take(rows) for k in (0, 1)]
                hashes = [pa.array(np.concatenate([x.view(np.int64), np.zeros(len(known[0]), np.int64)])) for x in (anchor, span)]
                ends = [pa.array(np.concatenate(x).astype(np.int32)) for x in ((n, np.zeros(len(known[0]))), (low, known[1]), (high, known[2]))]
                yield pa.RecordBatch.from_arrays([*hashes, ends[0], *keys, *ends[1:]], names=["anchor", "span", "n", *_KEY, "low", "high"])

            for text, base in _pieces(batch.column(2), window):
                doc, low, high, _, anchor, span = _sampled(text, window, core)
                begin = text.offsets[doc] - base
                held.append([np.ascontiguousarray(anchor), span, doc + text.first, low - begin, high - begin])
                if sum(len(x[0]) for x in held) > COMBINED:
                    yield from flush()
            yield from flush()

    return run


def _spans(window: int):
    """doc_id, version, text, places (anchor, spans, n, low, high) -> the places' bytes."""

    def run(batches):
        for batch in batches:
            column = batch.column(3)
            first = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            anchor, spans, n, low, high = column.flatten().flatten()
            lows, highs = low.to_numpy(), high.to_numpy()
            texts = [memoryview(v.as_buffer()) for v in batch.column(2).cast(pa.large_string())]
            # rows with one key have one text, but for a hash collision; a place outside the text is not read
            inside = highs + window <= np.array([len(t) for t in texts])[row]
            raw = pa.array([bytes(texts[r][a : b + window]) for r, a, b in zip(row[inside], lows[inside], highs[inside], strict=True)], pa.binary())
            at = pa.array(np.flatnonzero(inside))
            keys = [batch.column(k).take(pa.array(row[inside])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([anchor.take(at), spans.take(at), n.take(at), *keys, low.take(at), raw], names=["anchor", "spans", "n", "doc_id", "version", "low", "raw"])

    return run


_SPANS = "anchor long, spans long, n int, doc_id long, version int, low int, raw binary"


def sorted_windows(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``starts`` by their first ``window`` (16 or more) bytes, and for each place whether it has all
    of them in common with the place before. Ranks of 8 bytes are doubled."""
    padded = np.concatenate([data, np.zeros(window + 8, np.uint8)]).astype(_U)
    n = len(data)
    key = np.zeros(n + window, _U)
    for k in range(8):
        key |= padded[k : n + window + k] << _U(8 * (7 - k))
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    have = 8
    while have < window:
        step = min(have, window - have)
        rank = np.unique(rank[: len(rank) - step] * (rank.max() + 1) + rank[step:], return_inverse=True)[1]
        have += step
    order = np.argsort(rank[starts], kind="stable")
    ranked = rank[starts[order]]
    return order, np.concatenate([[False], ranked[1:] == ranked[:-1]])


def _ranges(flag: np.ndarray, span: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows: their span, first and last window."""
    hit = np.flatnonzero(flag)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (span[hit[1:]] != span[hit[:-1]])
    begin = hit[new]
    end = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else hit
    return span[begin], at[begin], at[end]


def _windows_of(raw: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes; of every window its byte number in them, its span, and its place in that span."""
    size = np.array([len(r) for r in raw])
    count = size - window + 1
    span = np.repeat(np.arange(len(raw)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(size) - size)[span] + place, span, place


def _repeated(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Of whole anchors' spans, the windows that repeat, at the places of spans that occur once."""
    data, starts, span, place = _windows_of(rows["raw"].to_pylist(), window)
    order, same = sorted_windows(data, starts, window)
    flag = np.zeros(len(starts), bool)
    flag[order[same]] = True
    flag[order[np.flatnonzero(same) - 1]] = True
    flag &= (rows["n"].to_numpy() == 1)[span]
    row, first, last = _ranges(flag, span, place)
    low = rows["low"].to_numpy()[row]
    keys = [rows[c].combine_chunks().take(pa.array(row)) for c in _KEY]
    return pa.RecordBatch.from_arrays([*keys, pa.array((low + first).astype(np.int32)), pa.array((low + last).astype(np.int32))], names=[*_KEY, "low", "high"])


def _neighbours(window: int):
    """Spans sorted by anchor -> repeats; an anchor's spans are sorted together, several anchors at once."""

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while held["raw"].nbytes > SORTED:
                anchor = held["anchor"].to_numpy()
                ends = np.flatnonzero(np.diff(anchor)) + 1
                size = np.cumsum([len(v.as_buffer()) for v in held["raw"]])
                ends = ends[: max(1, int(np.searchsorted(size[ends - 1], SORTED)))] if len(ends) else ends
                if not len(ends):
                    break
                yield _repeated(held.slice(0, ends[-1]), window)
                held = held.slice(ends[-1]).combine_chunks()
        if held is not None and held.num_rows:
            yield _repeated(held, window)

    return run


_ITEM = "doc_id long, version int, low int, n int, c0 int, raw binary, block int, a long, b long, part long, first int, last int"


def _halved(window: int, core: int, size: int):
    """Spans, or blocks of them, -> their blocks of ``size`` windows, as ``_refined`` compares them."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = pa.Table.from_batches([batch.slice(at, 2048)])
                raw = rows["raw"].to_pylist()
                length = np.array([len(r) for r in raw])
                begin = np.cumsum(length) - length
                data = np.frombuffer(b"".join(raw), np.uint8)
                if "c0" in rows.column_names:
                    c0, block = (rows[c].to_numpy().astype(np.int64) for c in ("c0", "block"))
                    low_block, high_block = block, block + size
                else:
                    # windows are numbered so that those with the anchor at one place have one number
                    where = _sampled(K.Text(data, np.append(begin, len(data)), 0), window, core)[3]
                    c0 = window - core - (where - begin)
                    low_block, high_block = c0 // size * size, (c0 + length - window) // size * size
                count = (high_block - low_block) // size + 1
                row = np.repeat(np.arange(len(raw)), count)
                block = low_block[row] + size * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
                first, end = np.maximum(c0[row], block), np.minimum((c0 + length - window + 1)[row], block + size)
                some = first < end
                row, block, first, end = row[some], block[some], first[some], end[some]
                shift = begin[row] - c0[row]
                hashes = []
                for k in (0, 1):
                    sums = K.byte_sums(data, k)
                    hashes.append(K.mix(K.hashes_between(sums, block + size - 1 + shift, block + window + shift, k) + block.astype(_U)))
                    if k:
                        hashes.append(K.mix(K.hashes_between(sums, first + shift, end - 1 + window + shift, k) + K.mix(first.astype(_U))))
                low = rows["low"].to_numpy().astype(np.int64)[row] - c0[row]
                own = pa.array(row)
                ints = lambda x: pa.array(x.astype(np.int32))
                keep = [rows[c].combine_chunks().take(own) for c in ("doc_id", "version", "low", "n")]
                yield pa.RecordBatch.from_arrays(
                    [*keep, ints(c0[row]), rows["raw"].combine_chunks().take(own), ints(block), *(pa.array(h.view(np.int64)) for h in hashes), ints(low + first), ints(low + end - 1)],
                    names=[f.split()[0] for f in _ITEM.split(", ")],
                )

    return run


def _refined(spans: DataFrame, window: int, core: int) -> list[DataFrame]:
    """Repeats among spans of anchors with many spans, staged; no task needs all spans of an anchor.

    Windows are numbered by their distance from the anchor and cut into blocks of equal numbers. Spans that share a window of a
    block have in common what all the block's windows cover, and are grouped by that (128 bits). Spans with all the same windows in the block
    repeat each other there, and one of them goes on for all; spans alone in their group are done. Where a group has several
    kinds left, its blocks are halved, down to single windows. So a round has a row for each span that still has a partner,
    not one for each window.
    """
    found, size = [], 1
    while 2 * size < window:
        size *= 2
    given = spans
    while size and not given.isEmpty():
        items = stage(given.mapInArrow(_halved(window, core, size), _ITEM), "items")
        kinds = items.groupBy("a", "b", "part").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "version", "low", "n", "c0", "raw", "block")).alias("one"))
        kinds = stage(kinds.withColumn("kinds", F.count("*").over(Window.partitionBy("a", "b"))), "kinds")
        same = kinds.where("c > 1").select("a", "b", "part")
        found.append(stage(items.where("n = 1").join(same, ["a", "b", "part"], "left_semi").select(*_KEY, F.col("first").alias("low"), F.col("last").alias("high")), "repeats"))
        rest = stage(kinds.where("kinds > 1").select("one.*"), "spans")
        discard(items)
        discard(kinds)
        if given is not spans:
            discard(given)
        given, size = rest, size // 2
    if given is not spans:
        discard(given)
    return found


def _merged(tables: list[DataFrame]) -> DataFrame:
    """One row for each span: whether it occurs once (1) or more often (2), and its first place."""
    rows = reduce(DataFrame.union, tables)
    grouped = rows.groupBy("anchor", "span").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.min(F.struct("doc_id", "version", "low", "high")).alias("p"))
    return grouped.select("anchor", "span", "n", "p.*")


class SuffixFamily:
    """Suffix arrays of the batches absorbed so far; ``path`` names a family to reopen or begin."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, core: int = CORE, fanout: int = FANOUT):
        self.spark, self.window, self.core = spark, window, core
        self.store = RunStore(spark, path, fanout=fanout)

    def absorb(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Repeated windows that ``docs`` brings about (``doc_id, version, low, high``), staged; the family then has the batch too.

        ``docs`` and ``history`` (what earlier batches held) are as ``keyed`` gives them. Ranges are of windows in
        ``docs`` and of windows in ``history`` that nothing repeated before.
        """
        store = self.store
        given = stage(docs.mapInArrow(_suffixes(self.window, self.core), "anchor long, span long, n int, " + _PLACE), "suffixes")
        seen = store.write(given.where("n > 0"))
        places = store.table(seen)
        found = [stage(given.where("n = 0").select(*_KEY, "low", "high"), "repeats")]
        discard(given)
        with by_bucket(self.spark):
            run = store.write(_merged([places]), dealt=True)
            fresh, levels = store.table(run), store.tables
            every = F.sum("n").over(Window.partitionBy("anchor", "span"))
            found.append(stage(places.withColumn("every", every).where("every > 1 and n = 1").select(*_KEY, "low", "high"), "repeats"))
            touched = []
            for level in levels:
                found.append(stage(places.join(level.select("anchor", "span").hint("merge"), ["anchor", "span"], "left_semi").select(*_KEY, "low", "high"), "repeats"))
                alone = level.where("n = 1").join(fresh.select("anchor", "span").hint("merge"), ["anchor", "span"], "left_semi")
                found.append(stage(alone.select(*_KEY, "low", "high"), "repeats"))
                touched.append(level.join(fresh.select("anchor").hint("merge"), "anchor", "left_semi"))
            known = _merged([fresh, *touched]) if touched else fresh
            several = known.withColumn("spans", F.count("*").over(Window.partitionBy("anchor"))).where("spans > 1")
            leaders = stage(several.select("anchor", "spans", "n", "doc_id", "version", "low", "high"), "leaders")
        lists = leaders.groupBy(*_KEY).agg(F.collect_list(F.struct("anchor", "spans", "n", "low", "high")).alias("places"))
        texts = docs if history is None else docs.union(history)
        spans = stage(texts.join(lists, _KEY).select(*_KEY, "text", "places").mapInArrow(_spans(self.window), _SPANS), "spans")
        small = spans.where(F.col("spans") <= GROUP).repartition(store.buckets, "anchor").sortWithinPartitions("anchor")
        found.append(stage(small.mapInArrow(_neighbours(self.window), _PLACE), "repeats"))
        found += _refined(spans.where(F.col("spans") > GROUP), self.window, self.core)
        out = stage(reduce(DataFrame.union, found), "ranges")
        store.drop(seen)
        store.add(run, _merged)
        for table in (*found, leaders, spans):
            discard(table)
        return out


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, version, text``: the id (``NO_ID`` for null) with a hash that tells texts of one id apart."""
    text_ = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.hash(text_).alias("version"), text_.alias("text"))


def _union(lows: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges [low, end) joined where they overlap or touch."""
    order = np.argsort(lows, kind="stable")
    low, end = lows[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], low[1:] > end[:-1]]))
    return list(zip(low[new].tolist(), end[np.append(new[1:], len(low)) - 1].tolist(), strict=True))


def _kept(window: int, keep_bytes: bool):
    """doc_id, version, text, places -> what is left of every document."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column(2).cast(pa.large_string()), batch.column(3), strict=True):
                raw = memoryview(text.as_buffer())
                gone = []
                if ranges.is_valid and len(ranges.values):
                    low, high = (x.to_numpy().astype(np.int64) for x in ranges.values.flatten())
                    gone = _union(low, np.minimum(high + window, len(raw)))
                state, kept, at = hashlib.sha256(), [], 0
                for low, end in [*gone, (len(raw), len(raw))]:
                    state.update(raw[at:low])
                    if keep_bytes:
                        kept.append(raw[at:low])
                    at = end
                row = (len(raw), sum(end - low for low, end in gone), len(gone), state.hexdigest())
                rows.append((*row, b"".join(kept)) if keep_bytes else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + keep_bytes]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_bytes]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True))] if rows else [pa.array([], k) for k in (pa.int64(), *kinds)], names=names)

    return run


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2, window: int = WINDOW, core: int = CORE, keep_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``) for every row of ``docs``.

    The table is fed to a new family in ``batches`` id ranges, as if it had arrived so.
    """
    given = keyed(docs, doc_id, text)
    family = SuffixFamily(docs.sparkSession, None, window, core)
    cuts = given.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("c")).first().c if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    found = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = given if low is None else given.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        found.append(family.absorb(part, None if low is None else given.where(F.col("doc_id") <= low)))
    family.store.delete()
    lists = stage(reduce(DataFrame.union, found).groupBy(*_KEY).agg(F.collect_set(F.struct("low", "high")).alias("places")), "ranges")
    for part in found:
        discard(part)
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    rows = given.join(lists, _KEY, "left").select(*_KEY, "text", "places").mapInArrow(_kept(window, keep_bytes), shape)
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
