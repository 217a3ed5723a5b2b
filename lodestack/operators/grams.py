"""Runs of words counted in their tasks, as numbers, so that only sums by bucket and the terms of heavy buckets are shuffled.

A term's bucket is a hash of its words. Sums over buckets bound what a term in them can reach: exact figures are needed of the terms
of the buckets that may hold a winner, and of no others. A first choice of buckets gives a threshold; if other buckets reach it, they are
taken too, so the result does not rest on the choice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import repeats

BITS = 20
#: Buckets taken at first.
FIRST = 1 << 14


def word_rows(docs: DataFrame, doc: str, words: Column) -> DataFrame:
    """``w``: the words of each document; rows of one id are one document, with a null between them, which no run crosses."""
    rows = docs.select(F.col(doc).alias("doc"), words.alias("w")).where("size(w) > 0")
    if repeats(docs, doc):
        rows = rows.groupBy("doc").agg(F.flatten(F.collect_list(F.concat("w", F.array(F.lit(None).cast("string"))))).alias("w"))
    return rows.select("w")


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words (FNV-1a, a byte of all words at a time)."""
    data = words.cast(pa.binary())
    size = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer(b"".join(data.to_pylist()), np.uint8).astype(np.uint64)
    begin, h = np.cumsum(size) - size, np.full(len(size), 0xCBF29CE484222325, np.uint64)
    left = np.arange(len(size))
    for i in range(int(size.max(initial=0))):
        left = left[size[left] > i]
        h[left] = (h[left] ^ flat[begin[left] + i]) * np.uint64(0x100000001B3)
    return h


class Runs:
    """All runs of ``low`` to ``high`` words of some documents: row, first word, number of words and bucket of each."""

    def __init__(self, w: pa.Array, low: int, high: int):
        size = w.value_lengths().to_numpy().astype(np.int64)
        coded = w.flatten().dictionary_encode()
        self.words, code = coded.dictionary, coded.indices.fill_null(-1).to_numpy().astype(np.int64)
        one = np.where(code >= 0, _hashes(self.words)[code] if len(self.words) else np.uint64(0), np.uint64(0))
        row = np.repeat(np.arange(len(size)), size)
        ok, h = code >= 0, one
        at, k_, bucket = [], [], []
        for k in range(1, high + 1):
            if k > 1:  # of the words before, and this one
                n = len(code) - k + 1
                ok = ok[:-1] & (code[k - 1 :] >= 0) & (row[k - 1 :] == row[: max(n, 0)]) if n > 0 else np.zeros(0, bool)
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[k - 1 :] if n > 0 else np.zeros(0, np.uint64)
            if k >= low:
                here = np.flatnonzero(ok)
                mixed = h[here] ^ (h[here] >> np.uint64(29))
                at.append(here)
                k_.append(np.full(len(here), k))
                bucket.append(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64))
        self.code, self.at, self.k, self.bucket = code, np.concatenate(at), np.concatenate(k_), np.concatenate(bucket)
        self.row = row[self.at]
        self.total = np.bincount(self.row, minlength=len(size))

    def counted(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of the runs that ``keep`` marks: the row, term and count of each term of a row, and the terms."""
        at, k, row = self.at[keep], self.k[keep], self.row[keep]
        term = np.zeros(len(at), np.int64)
        for i in range(int(k.max(initial=0))):
            word = np.where(k > i, self.code[np.minimum(at + i, max(len(self.code) - 1, 0))] + 1, 0)
            term = np.unique(term * (len(self.words) + 1) + word, return_inverse=True)[1]
        first = np.unique(term, return_index=True)[1]
        names = self.words.to_pylist()
        text = pa.array([" ".join(names[c] for c in self.code[at[f] : at[f] + k[f]]) for f in first], pa.string())
        key, n = np.unique(row * max(len(first), 1) + term, return_counts=True)
        return key // max(len(first), 1), key % max(len(first), 1), n, text


def _batches(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            yield batch.column(0).slice(i, min(1000, batch.num_rows - i))


def bucket_sums(rows: DataFrame, low: int, high: int, shares: bool) -> np.ndarray:
    """For each bucket the number of its runs, or with ``shares`` the sum of their shares of their documents."""

    def run(batches):
        sums = np.zeros(1 << BITS)
        for w in _batches(batches):
            r = Runs(w, low, high)
            sums += np.bincount(r.bucket, (1 / r.total[r.row]) if shares else None, 1 << BITS)
        at = np.flatnonzero(sums)
        for i in range(0, len(at), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 10_000].astype(np.int32)), pa.array(sums[at[i : i + 10_000]])], names=["bucket", "s"])

    found = rows.mapInArrow(run, "bucket int, s double").groupBy("bucket").agg(F.sum("s").alias("s")).toArrow()  # at most 2 ** BITS rows
    out = np.zeros(1 << BITS)
    out[found["bucket"].to_numpy()] = found["s"].to_numpy()
    return out


def term_sums(rows: DataFrame, low: int, high: int, chosen: np.ndarray) -> DataFrame:
    """``term, df, cf, share`` of all terms of the ``chosen`` buckets: documents, occurrences, and shares of documents summed up."""
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        for w in _batches(batches):
            r = Runs(w, low, high)
            row, term, n, text = r.counted(shared.value[r.bucket])
            add = lambda v=None: np.bincount(term, v, len(text))
            yield pa.RecordBatch.from_arrays([text, pa.array(add()), pa.array(add(n).astype(np.int64)), pa.array(add(n / r.total[row]))], names=["term", "df", "cf", "share"])

    sums = rows.mapInArrow(run, "term string, df long, cf long, share double")
    return sums.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "cf", "share")])


def winners(rows: DataFrame, low: int, high: int, most: int, shares: bool, factor: float, ranked) -> DataFrame:
    """``ranked(term_sums)``, its first ``most`` rows with the value ``least``, over as few buckets as prove that no other term is among them.

    No term's value exceeds ``factor`` times the sum of its bucket.
    """
    reach = bucket_sums(rows, low, high, shares) * factor
    order = np.argsort(-reach, kind="stable")
    n = min(FIRST, len(order))
    while True:
        chosen = np.zeros(len(reach), bool)
        chosen[order[:n]] = True
        best = ranked(term_sums(rows, low, high, chosen)).limit(most).toArrow()  # at most ``most`` rows
        least = min(best["least"].to_pylist()) - 1e-5 if best.num_rows == most else 0.0
        need = max(int(np.count_nonzero(reach >= least)) if least > 0 else int(np.count_nonzero(reach)), 1)
        if need <= n:
            return rows.sparkSession.createDataFrame(best)
        n = need


def unit_sums(rows: DataFrame, low: int, high: int, words: DataFrame) -> DataFrame:
    """``term, s``: of the terms in ``words`` (``term, idf``), their (1 + ln tf) * idf in documents scaled to length 1, summed up."""
    known = words.select("term", "idf").toArrow()  # a vocabulary
    names = known["term"].combine_chunks() if known.num_rows else pa.array([], pa.string())
    own = Runs(pa.array([t.split(" ") for t in names.to_pylist()], pa.list_(pa.string())), low, high)
    chosen = np.zeros(1 << BITS, bool)
    size = np.array([t.count(" ") + 1 for t in names.to_pylist()], np.int64)
    chosen[own.bucket[own.k == size[own.row]]] = True
    shared = rows.sparkSession.sparkContext.broadcast((chosen, names, known["idf"].to_numpy()))

    def run(batches):
        chosen, names, idf = shared.value
        sums = np.zeros(len(names))
        for w in _batches(batches):
            r = Runs(w, low, high)
            row, term, n, text = r.counted(chosen[r.bucket])
            place = pc.index_in(text, value_set=names).fill_null(-1).to_numpy()[term]
            row, place, n = row[place >= 0], place[place >= 0], n[place >= 0]
            x = (1 + np.log(n)) * idf[place]
            norm = np.sqrt(np.bincount(row, x * x, len(w)))
            sums += np.bincount(place, x / norm[row], len(names))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(sums[at])], names=["term", "s"])

    return rows.mapInArrow(run, "term string, s double").groupBy("term").agg(F.sum("s").alias("s"))
