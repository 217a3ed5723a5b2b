"""Language identification by error-correcting output codes.

Every language gets a codeword of +1/-1 bits. For each bit a binary classifier over hashed
byte n-grams tells the languages with +1 from those with -1; its weights are log ratios of
smoothed gram frequencies, taken from one distributed count over all labelled rows. A text's
bit margins are decoded to the codeword of least weighted logistic loss. Margins are sums over at
most ``EVIDENCE`` grams' worth of text: longer texts count with their mean margin, so that a text of two
languages has small margins however long it is, and doubt shows.

``distance`` tells how far a text lies from its codeword. A bit's mean margin is compared with the one that
labelled texts of the codeword's side have on average: 0 if it is as large, 1/2 if the text says nothing of
the bit (as half-and-half mixtures do of bits that part their languages), 1 if it is as large on the other
side; bits count by weight. A text is ``ambiguous`` where the two best codewords are about as likely.

Null or letterless text is ``und`` with score 0, distance 0 and no doubt. Rows with a null language teach
nothing. A table without labelled rows gives a model that answers ``und`` throughout. Of equally likely
languages the first by code point is taken; repeated rows teach, and are answered, each by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import fresh_name, without

UNDETERMINED = "und"
#: Slots of hashed grams: one byte, two bytes, three bytes.
_SLOTS = (256, 4096, 16384)
_FEATURES = sum(_SLOTS)
_SLICE = 1 << 18
#: Bytes of a long text whose grams are weighed at once.
_PART = 1 << 20
#: Numbers in the products of texts, languages and bits that are held at once.
_CELLS = 1 << 21
_SHAPE = "lang_pred string, score double, ambiguous boolean, distance double"
#: Bytes of text whose margins count in full.
EVIDENCE = 60


def _grams(text: K.Text) -> list[np.ndarray]:
    """For each width, the feature at every byte position; the last one where a gram would leave its document."""
    data = K.lowered(text.data).astype(np.uint32)
    out, code, base = [data.astype(np.intp)], data, _SLOTS[0]
    for width, slots in ((2, _SLOTS[1]), (3, _SLOTS[2])):
        code = (code << np.uint32(8)) | np.concatenate([data[width - 1 :], np.zeros(width - 1, np.uint32)])[: len(data)]
        slot = ((code * np.uint32(2654435761)) >> np.uint32(33 - slots.bit_length())).astype(np.intp) + base
        for back in range(1, width):
            last = text.offsets[1:] - back
            slot[last[last >= text.offsets[:-1]]] = _FEATURES
        out.append(slot)
        base += slots
    return out


def _has_letter(text: K.Text) -> np.ndarray:
    out = np.zeros(len(text), bool)
    for part, _ in K.parts(text, _PART, 0):
        low = K.lowered(part.data)
        out |= K.per_doc((low >= 97) & (low <= 122), part.offsets) > 0
        for i in np.flatnonzero(~out & (K.per_doc(part.data >= 128, part.offsets) > 0)):
            raw = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().decode("utf-8", "replace")
            out[i] = any(c.isalpha() for c in raw)
    return out


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        coded = batch.column(1).dictionary_encode()
        names, rows = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        totals = np.zeros((len(names), _FEATURES + 1), np.int64)
        for text in K.slices(batch.column(0), _SLICE):
            for part, own in K.parts(text, _PART, 2):
                shift = np.repeat(rows[part.first : part.first + len(part)].astype(np.intp), np.diff(part.offsets))[:own] * (_FEATURES + 1)
                for slot in _grams(part):
                    totals += np.bincount(slot[:own] + shift, minlength=totals.size).reshape(totals.shape)
        for name, row in zip(names, totals, strict=True):
            have = counts.setdefault(name, np.zeros(_FEATURES, np.int64))
            have += row[:-1]
    for name, have in counts.items():
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(have[at])],
            names=["lang", "feature", "n"],
        )


def codewords(k: int, seed: int = 0) -> np.ndarray:
    """A k x bits matrix of +1/-1 whose rows lie far apart; each bit splits the languages."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:  # all splits of the languages in two
        bits = range(1, 1 << (k - 1))
        return np.array([[1.0 if row and b >> (row - 1) & 1 else -1.0 for b in bits] for row in range(k)])
    width, best, best_gap = 8 * int(np.ceil(np.log2(k))), None, -1
    rng = np.random.default_rng(seed)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, width))
        code = code[:, np.abs(code.sum(0)) < k]
        gap = int((code.shape[1] - (code @ code.T)[np.triu_indices(k, 1)].max()) / 2)
        if gap > best_gap:
            best, best_gap = code, gap
    return best


@dataclass
class LanguageModel:
    """Languages, codewords, gram weights by bit and the bits' weights in decoding."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray
    usual: np.ndarray  # mean margins a byte of labelled texts: one row for bits -1, one for bits +1
    margin: float

    @staticmethod
    def fit(
        labelled: DataFrame, text: str = "text", lang: str = "lang", margin: float = 0.2
    ) -> LanguageModel:
        """Learn from the text and language of all rows; the driver gets one vector of 166 kB for each language."""
        counts = (
            labelled.where(F.col(f"`{lang}`").isNotNull())
            .select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
            .mapInArrow(_count, "lang string, feature int, n long")
            .groupBy("lang", "feature")
            .agg(F.sum("n").alias("n"))
        )
        table: dict[str, np.ndarray] = {}
        lists = counts.groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("c")).select("lang", "c.feature", "c.n")
        for row in lists.toArrow().to_batches(max_chunksize=16):
            for name, feature, n in zip(*row.columns, strict=True):
                vector = table.setdefault(name.as_py(), np.zeros(_FEATURES))
                vector[feature.values.to_numpy(zero_copy_only=False)] = n.values.to_numpy(zero_copy_only=False)
        langs = sorted(table)
        code = codewords(len(langs))
        if not langs:
            return LanguageModel([], code, np.zeros((_FEATURES + 1, 1), np.float32), np.ones(1), np.ones((2, 1)), margin)
        seen = sum(table.values()) > 0  # grams that no labelled text has tell nothing
        share = np.stack([(table[x] + 0.5) / (table[x].sum() + 0.5 * _FEATURES) for x in langs])
        weights, sharp, usual = [], [], []
        for bit in code.T:
            yes = share[bit > 0].mean(0) if (bit > 0).any() else share.mean(0)
            no = share[bit < 0].mean(0) if (bit < 0).any() else share.mean(0)
            ratio = (np.log(yes) - np.log(no)) * seen
            weights.append(ratio)
            usual.append([len(_SLOTS) * max(1e-9, -(no * ratio).sum()), len(_SLOTS) * max(1e-9, (yes * ratio).sum())])
            sharp.append(np.sqrt(((yes - no) * ratio).sum()))
        sharp = np.array(sharp) if np.sum(sharp) > 0 else np.ones(len(weights))
        return LanguageModel(langs, code, np.stack([np.append(w, 0) for w in weights], 1).astype(np.float32), sharp / sharp.mean(), np.array(usual).T, margin)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of bit margins the best language, and the probabilities of the best and the second."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.bit_weights
        like = np.exp(-(loss - loss.min(1, keepdims=True)))
        like /= like.sum(1, keepdims=True)
        best = like.argmax(1)
        top = np.sort(like, 1)
        second = top[:, -2] if top.shape[1] > 1 else np.zeros(len(top))
        return best, np.stack([top[:, -1], second], 1)

    def distance(self, means: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of mean margins a byte from the codewords of the languages ``best``."""
        word = self.code[best]
        part = means * word / np.where(word > 0, self.usual[1], self.usual[0])
        return np.clip(1 - part, 0, 2) @ self.bit_weights / (2 * self.bit_weights.sum())

    def _predict(self, column: pa.Array) -> pa.Array:
        names, scores, doubts, distances = [], [], [], []
        for text in K.slices(column, _SLICE):
            totals = np.zeros((len(text), self.weights.shape[1]))
            size = np.diff(text.offsets)
            for part, own in K.parts(text, _PART, 2):
                full = np.flatnonzero(np.diff(part.offsets))
                if len(full):
                    one, two, three = (slot[:own] for slot in _grams(part))
                    sums = self.weights[one]
                    sums += self.weights[two]
                    sums += self.weights[three]
                    totals[full] += np.add.reduceat(sums, part.offsets[full], axis=0, dtype=np.float64)
            means = totals / np.maximum(size, 1)[:, None]
            totals = means * np.minimum(size, EVIDENCE)[:, None]
            named = _has_letter(text) & bool(self.langs)
            best, like, apart = np.zeros(len(text), int), np.zeros((len(text), 2)), np.zeros(len(text))
            rows = max(1, _CELLS // max(1, self.code.size))
            for low in range(0, len(text) if self.langs else 0, rows):
                part = slice(low, low + rows)
                best[part], like[part] = self.decode(totals[part])
                apart[part] = self.distance(means[part], best[part])
            names += [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, named, strict=True)]
            scores.append(np.where(named, like[:, 0], 0.0))
            doubts.append(named & (like[:, 0] - like[:, 1] < self.margin))
            distances.append(np.where(named, apart, 0.0))
        flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), flat(scores, pa.float64()), flat(doubts, pa.bool_()), flat(distances, pa.float64())],
            names=["lang_pred", "score", "ambiguous", "distance"],
        )

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``lang_pred``, ``score``, ``ambiguous`` and ``distance``; columns of these names are replaced."""
        model = docs.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(_SHAPE)
        def predicted(column: pa.Array) -> pa.Array:
            return model.value._predict(column)

        found = fresh_name(docs, "found")
        kept = without(docs, "lang_pred", "score", "ambiguous", "distance")
        given = docs.withColumn(found, predicted(F.col(f"`{text}`").cast("string")))
        return given.select(*[F.col(f"`{c}`") for c in kept.columns], f"{found}.*")
