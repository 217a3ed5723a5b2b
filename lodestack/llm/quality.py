"""Quality rules with distribution divergence against language references.

Base rules count words, symbols, repeated lines and repeated word windows. The verdict then
compares a document's histograms of character classes and of common words with those of each
language (Jensen-Shannon distance, base 2, 0 to 1) and takes the nearest language. A document is
rejected where either distance passes its limit; sampling noise makes short texts differ from any
reference, so texts under ``min_words`` words are not judged by distance.

References cover all rows with a language. A language's common words are those with at least
``common_share`` of its words, which bounds their number by 1 / common_share. They are found exactly,
however rows are dealt: tasks cut their text into units of about ``UNIT`` words of a language and name each
word with half the share of a unit. What a unit does not name it has fewer times, so a word whose named
counts, plus half the share of all other units, stay under the share is not common. At most
2 / common_share words of a language are left; a second pass counts those in all rows, and the share is
applied to these counts.

Null text counts as empty: no words, fails the base rules. Without any language there is no
reference, and base rules alone decide. Of equally near languages the first by code point is taken.
Repeated rows count, and are judged, each by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stage
from . import kernel as K
from .common import fresh_name, without

WINDOW = 5
#: Words of a language that a task counts together.
UNIT = 1 << 16
#: Texts compared with the references at once.
_ROWS = 1 << 10
_SLICE = 1 << 19
#: Character classes by byte: lower, upper, digit, sentence marks, other marks, white space,
#: lead bytes of two-byte (Latin, other), three-byte and four-byte characters; continuation bytes are not counted.
_CLASS = np.full(256, 10, np.int64)
_CLASS[:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:'\"!?-()"]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_CLASS[0xC2:0xC4], _CLASS[0xC4:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:0xF8] = 6, 7, 8, 9
_CLASSES = 10
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_SHAPE = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, char_distance double, word_distance double"
)


def _base_counts(text: K.Text, w: K.Words, exact: np.ndarray) -> list[np.ndarray]:
    """Per document: words, code points in words, symbols, repeated lines, words in repeated windows."""
    data = text.data
    solid = (data & 0xC0) != 0x80
    blank = _CLASS[data] == 5
    chars = K.per_doc(solid & ~blank, text.offsets)
    symbols = K.per_doc(_SYMBOL[data], text.offsets)
    # lines with a word: from a document's start or a \n to the next \n or the document's end
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([text.offsets[:-1], breaks + 1]))
    doc = np.searchsorted(text.offsets, begin, "right") - 1
    inside = (begin < text.offsets[-1]) & (doc < len(text))
    begin, doc = begin[inside], doc[inside]
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], text.offsets[doc + 1])
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end, doc = begin[worded], end[worded], doc[worded]
    lines = K.range_hashes(data, begin, end, 1)
    _, again = _repeats(lines, doc)
    dup_lines = np.bincount(doc[again], minlength=len(text))
    at = K.window_starts(w, WINDOW)
    any_, _ = _repeats(K.span_hashes(K.sums_of(exact), at, at + WINDOW), w.doc[at])
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, at[any_], 1)
    np.add.at(cover, at[any_] + WINDOW, -1)
    repeated = K.per_doc(np.cumsum(cover)[:-1] > 0, w.first)
    return [np.diff(w.first), chars, symbols, dup_lines, repeated]


def _repeats(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of values found twice or more in their document; the same less the first of each."""
    key = K.mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    return order[same[1:] | same[:-1]], order[same[:-1]]


def _named_words(common_share: float):
    """text, lang -> for each language its words, and for each word named by a unit: its count there and the units' words."""

    def run(batches):
        total: dict[str, int] = {}
        named: dict[tuple, list[int]] = {}
        held: dict[str, list[np.ndarray]] = {}

        def close(name):
            unit = np.concatenate(held.pop(name))
            values, counts = np.unique(unit, return_counts=True)
            some = 2 * counts >= common_share * len(unit)
            for v, c in zip(values[some].view(np.int64).tolist(), counts[some].tolist(), strict=True):
                have = named.setdefault((name, v), [0, 0])
                have[0] += c
                have[1] += len(unit)

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for text in K.slices(batch.column(0), _SLICE):
                w = K.words(text)
                hashes = K.range_hashes(K.lowered(text.data), w.start, w.end)
                own = langs[text.first : text.first + len(text)]
                lang = np.repeat(np.arange(len(own)), np.diff(w.first))
                for name in set(own):
                    mine = hashes[(own == name)[lang]] if len(lang) else hashes
                    total[name] = total.get(name, 0) + len(mine)
                    held.setdefault(name, []).append(mine)
                    if sum(map(len, held[name])) >= UNIT:
                        close(name)
        for name in list(held):
            close(name)
        rows = [(name, None, n, 0) for name, n in total.items()] + [(*k, *v) for k, v in named.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "word", "n", "units"])

    return run


def _slots(text: K.Text, w: K.Words, vocabulary: np.ndarray) -> np.ndarray:
    """For every word its place in the vocabulary, or the vocabulary's size."""
    hashes = K.range_hashes(K.lowered(text.data), w.start, w.end)
    slot = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    return np.where(vocabulary[slot] == hashes, slot, len(vocabulary)) if len(vocabulary) else slot


def _grouped(groups: np.ndarray, values: np.ndarray, n: int, size: int) -> np.ndarray:
    """Counts of each value below ``size``, for each of ``n`` groups."""
    return np.bincount(groups * size + values, minlength=n * size).reshape(n, size)


def _reference_counts(vocabulary: np.ndarray):
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            names, rows = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.intp)
            for text in K.slices(batch.column(0), _SLICE):
                w = K.words(text)
                own = rows[text.first : text.first + len(text)]
                chars = _grouped(np.repeat(own, np.diff(text.offsets)), _CLASS[text.data], len(names), _CLASSES + 1)
                found = _grouped(own[w.doc], _slots(text, w, vocabulary), len(names), len(vocabulary) + 1)
                for name, row in zip(names, np.hstack([chars[:, :_CLASSES], found]), strict=True):
                    total[name] = total.get(name, 0) + row
        for name, row in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(row), pa.string()), pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], names=["lang", "slot", "n"]
            )

    return run


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, over the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


@dataclass
class QualityRules:
    """Language references and limits."""

    langs: list[str]
    vocabulary: np.ndarray
    char_reference: np.ndarray
    word_reference: np.ndarray
    min_words: int = 50
    max_char_distance: float = 0.3
    max_word_distance: float = 0.4

    @staticmethod
    def fit(docs: DataFrame, text: str = "text", lang: str = "lang", common_share: float = 0.005, **limits) -> QualityRules:
        """References from all rows with a language; the driver gets a vector of the vocabulary's size for each language."""
        given = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
        named = given.mapInArrow(_named_words(common_share), "lang string, word long, n long, units long")
        counts = stage(named.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("units").alias("units")), "words")
        sizes = counts.where("word is null").select("lang", F.col("n").alias("all"))
        most = F.col("n") + F.lit(common_share / 2) * (F.col("all") - F.col("units"))
        known = counts.where("word is not null").join(F.broadcast(sizes), "lang")  # a row for each language
        likely = known.where(most >= common_share * F.col("all") - 1e-6).select("word").distinct().toArrow()
        discard(counts)
        words = np.unique(likely["word"].to_numpy().view(np.uint64))
        width = _CLASSES + len(words) + 1
        table: dict[str, np.ndarray] = {}
        rows = given.mapInArrow(_reference_counts(words), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
        for name, slot, n in zip(*(rows[c].to_pylist() for c in ("lang", "slot", "n")), strict=True):
            table.setdefault(name, np.zeros(width))[slot] = n
        langs = sorted(table)
        both = np.array([table[x] for x in langs]).reshape(len(langs), width)
        chars, found = both[:, :_CLASSES], both[:, _CLASSES:]
        total = found.sum(1, keepdims=True)
        common = ((found >= common_share * total) & (found > 0))[:, :-1].any(0)
        found = np.hstack([found[:, :-1][:, common], total - found[:, :-1][:, common].sum(1, keepdims=True)])
        share = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1)
        return QualityRules(langs, words[common], share(chars), share(found), **limits)

    def _judge(self, column: pa.Array) -> pa.Array:
        parts: list[list[np.ndarray]] = []
        for text in K.slices(column, _SLICE):
            w = K.words(text)
            counts = _base_counts(text, w, K.range_hashes(text.data, w.start, w.end))
            n, repeated = counts[0], counts[4]
            failed = (n < 10) | (100 * repeated > 20 * n)
            char, word = np.zeros(len(text)), np.zeros(len(text))
            slots = _slots(text, w, self.vocabulary) if self.langs else None
            for low in range(0, len(text) if self.langs else 0, _ROWS):  # bounds the histograms of many short texts
                high = min(low + _ROWS, len(text))
                by_byte = np.repeat(np.arange(high - low), np.diff(text.offsets[low : high + 1]))
                chars = _grouped(by_byte, _CLASS[text.data[text.offsets[low] : text.offsets[high]]], high - low, _CLASSES + 1)[:, :_CLASSES]
                own = slice(w.first[low], w.first[high])
                found = _grouped(w.doc[own] - low, slots[own], high - low, len(self.vocabulary) + 1)
                share = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1)
                chars, found = share(chars), share(found)
                least = np.full(high - low, np.inf)
                for k in range(len(self.langs)):  # one language at a time, so memory doesn't grow with their number
                    by_char, by_word = js_distance(chars, self.char_reference[k]), js_distance(found, self.word_reference[k])
                    near = by_char + by_word < least
                    least[near] = (by_char + by_word)[near]
                    char[low:high][near], word[low:high][near] = by_char[near], by_word[near]
            far = (n >= self.min_words) & ((char > self.max_char_distance) | (word > self.max_word_distance))
            parts.append([*counts, failed, ~failed & ~far, char, word])
        names = [f.split()[0] for f in _SHAPE.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kind) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, names=names)

    def apply(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with counts, verdicts and distances; columns of these names are replaced."""
        rules = docs.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(_SHAPE)
        def judged(column: pa.Array) -> pa.Array:
            return rules.value._judge(column)

        found = fresh_name(docs, "found")
        kept = without(docs, *[f.split()[0] for f in _SHAPE.split(", ")])
        given = docs.withColumn(found, judged(F.col(f"`{text}`").cast("string")))
        return given.select(*[F.col(f"`{c}`") for c in kept.columns], f"{found}.*")
