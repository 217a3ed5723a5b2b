"""Toxic spans by a linear-chain conditional random field.

Chains are the lines of a text, states are clean and toxic, and a token's features are its
lower-cased word without marks at its ends and the word's beginnings of 4 to 8 bytes. Labels exist
for documents only, so tokens are labelled first: a greedy cover picks the features that mark most
toxic documents not marked yet and hardly any clean one; a token with a picked feature, in a toxic
document, is a toxic token. The field's weights are then fitted to the token labels by quasi-Newton
ascent on the conditional likelihood; its gradient needs the marginals of tokens and of neighbouring
pairs, and both come from forward-backward passes.

A document's raw score combines the marginals of all its tokens (the probability that any is
toxic) and is calibrated on the documents of the sample. Fitting uses a bounded sample of
``max_rows`` labelled rows on the driver, those of least hash of the id; scoring covers every row.

Null and empty text have no tokens; their score is the calibrated score of no evidence. Rows with a
null label or a null id teach nothing, and of rows with one id the greatest label and the least text do.
Without labelled rows of both kinds every score is the prior. Every repeated row gets its score; equal
texts get equal scores.
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

PREFIXES = (4, 5, 6, 7, 8)
SLOTS = 1 << 18
#: Marginals below this count as none, lest a long text's many faint ones add up.
FAINT = 0.05
_SLICE = 1 << 19
_SHAPE = "score double, spans array<struct<start:long,end:long,probability:double>>"
_WORDY = np.zeros(256, bool)
_WORDY[48:58] = _WORDY[65:91] = _WORDY[97:123] = _WORDY[128:] = True


@dataclass
class _Tokens:
    words: K.Words
    features: np.ndarray  # tokens x features; 0 where a token has no such feature
    chain: np.ndarray  # first token of each chain (one more)


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented capitals of Latin-1."""
    low = K.lowered(data)
    accented = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[accented] += 0x20
    return low


def _tokens(text: K.Text) -> _Tokens:
    w = K.words(text)
    data = _lowered(text.data)
    # trim marks: the first and last byte of a letter or digit within the word, if any
    at = np.flatnonzero(_WORDY[data])
    first, last = np.searchsorted(at, w.start), np.searchsorted(at, w.end)
    has = last > first
    start = np.where(has, at[np.minimum(first, max(len(at) - 1, 0))], w.start) if len(at) else w.start
    end = np.where(has, at[np.maximum(last, 1) - 1] + 1, w.end) if len(at) else w.end
    sums = K.byte_sums(data)
    columns = [K.hashes_between(sums, start, end)]
    for k, size in enumerate(PREFIXES, 1):
        long = end - start >= size
        cut = np.where(long, start + size, start)
        columns.append(np.where(long, K.mix(K.hashes_between(sums, start, cut) + np.uint64(k)), np.uint64(0)))
    breaks = np.union1d(np.searchsorted(w.start, np.flatnonzero(data == 10)), w.first)
    chain = breaks[breaks < len(w)]
    return _Tokens(w, np.stack(columns, 1) if len(w) else np.zeros((0, len(PREFIXES) + 1), np.uint64), np.append(chain, len(w)))


@dataclass
class _Passes:
    """Messages of a forward and a backward pass, as ratios of state 1 to state 0."""

    odds: np.ndarray  # of each token by itself
    forward: np.ndarray  # with the token's own
    backward: np.ndarray  # without
    log_z: float


def _passes(unary: np.ndarray, chain: np.ndarray, trans: np.ndarray) -> _Passes:
    """One step handles the tokens of all chains at a place.

    ``unary`` is the log potential of state 1 against state 0, ``trans`` the 2 x 2 potentials.
    """
    n = len(unary)
    e = np.exp(np.clip(unary, -30, 30))
    forward, backward = np.empty(n), np.ones(n)
    if not n:
        return _Passes(e, forward, backward, 0.0)
    length = np.diff(chain)
    order = np.argsort(-length, kind="stable")
    start, length = chain[:-1][order], length[order]
    live = np.searchsorted(-length, -np.arange(length[0]), "left")  # chains longer than t
    at = start
    forward[at] = e[at]
    norm = np.ones(n)
    for k in live[1:].tolist():
        before = forward[at[:k]]
        at = at[:k] + 1
        norm[at] = trans[0, 0] + before * trans[1, 0]
        forward[at] = e[at] * (trans[0, 1] + before * trans[1, 1]) / norm[at]
    for t in range(length[0] - 2, -1, -1):
        here = start[: live[t + 1]] + t
        after = e[here + 1] * backward[here + 1]
        backward[here] = (trans[1, 0] + trans[1, 1] * after) / (trans[0, 0] + trans[0, 1] * after)
    log_z = np.log(norm).sum() + np.log1p(forward[chain[1:] - 1]).sum()
    return _Passes(e, forward, backward, float(log_z))


def marginals(unary: np.ndarray, chain: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of state 1 at every token."""
    found = _passes(unary, chain, trans)
    odds = found.forward * found.backward
    return odds / (1 + odds)


def pair_sums(found: _Passes, inner: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected number of each pair of states over the tokens ``inner`` and those before them."""
    before, after = found.forward[inner - 1], found.odds[inner] * found.backward[inner]
    parts = [np.full(len(inner), trans[0, 0]), trans[0, 1] * after, trans[1, 0] * before, trans[1, 1] * before * after]
    total = sum(parts)
    return np.array([np.sum(x / total) for x in parts]).reshape(2, 2)


def _cover(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray, weight: np.ndarray, precision: float, support: float) -> np.ndarray:
    """Features picked greedily: each marks toxic documents not marked yet, at least ``support`` of all.

    ``precision`` is the least share of a feature's tokens, weighted by document, in toxic documents.
    """
    # only features of toxic documents can be picked
    names = np.unique(features[toxic[doc]])
    names = names[names != 0]
    mass, bad, parts = np.zeros(len(names)), np.zeros(len(names)), []
    for column in features.T:
        at = np.minimum(np.searchsorted(names, column), max(len(names) - 1, 0))
        known = np.flatnonzero(names[at] == column) if len(names) else at[:0]
        index, pair_doc = at[known], doc[known]
        mass += np.bincount(index, weight[pair_doc], minlength=len(names))
        bad += np.bincount(index, (weight * ~toxic)[pair_doc], minlength=len(names))
        mine = toxic[pair_doc]
        parts.append(np.unique(index[mine] * len(toxic) + pair_doc[mine]))
    pairs = np.unique(np.concatenate(parts))
    feature, document = pairs // len(toxic), pairs % len(toxic)
    sure = mass - bad >= precision * mass
    use = sure[feature]
    feature, document = feature[use], document[use]
    least = max(5.0, support * toxic.sum())
    open_, picked = toxic.copy(), []
    while True:
        gain = np.bincount(feature[open_[document]], minlength=len(names))
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] < least:
            return names[picked]
        picked.append(best)
        open_[document[feature == best]] = False


def likelihood(theta: np.ndarray, index: np.ndarray, chain: np.ndarray, labels: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Penalised log likelihood of the labels, a toxic token each, and its gradient.

    ``theta`` holds the weights of features (``index`` names them by token; the first is fixed at 0), the
    bias and the log potentials of the pairs 01, 10 and 11.
    """
    m = len(theta) - 4
    weights, bias, pairs = theta[:m], theta[m], theta[m + 1 :]
    log_trans = np.array([[0.0, pairs[0]], [pairs[1], pairs[2]]])
    unary = weights[index].sum(1) + bias
    trans = np.exp(log_trans)
    found = _passes(unary, chain, trans)
    inner = np.ones(len(labels), bool)
    inner[chain[:-1]] = False
    inner = np.flatnonzero(inner)
    seen = np.bincount((2 * labels[inner - 1] + labels[inner]).astype(int), minlength=4).reshape(2, 2)
    odds = found.forward * found.backward
    gap = labels - odds / (1 + odds)
    scale = max(1.0, labels.sum())
    value = (labels @ unary + (seen * log_trans).sum() - found.log_z) / scale - l2 / 2 * (weights @ weights + pairs @ pairs)
    g_w = np.zeros(m)
    for column in index.T:
        g_w += np.bincount(column, gap, minlength=m)
    g_w = g_w / scale - l2 * weights
    g_w[0] = 0
    g_t = (seen - pair_sums(found, inner, trans)).reshape(-1)[1:] / scale - l2 * pairs
    return value, np.concatenate([g_w, [gap.sum() / scale], g_t])


def _ascend(value_of, theta: np.ndarray, rounds: int, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """Quasi-Newton ascent with a limited memory of steps and halved steps where the value falls."""
    value, slope = value_of(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        move, used = slope.copy(), []
        for s, y in reversed(steps):
            a = (s @ move) / (s @ y)
            used.append(a)
            move -= a * y
        if steps:
            s, y = steps[-1]
            move *= (s @ y) / (y @ y)
        else:
            move /= max(1.0, np.abs(move).sum())
        for (s, y), a in zip(steps, reversed(used), strict=True):
            move += s * (a - (y @ move) / (s @ y))
        size, gain = 1.0, move @ slope
        while True:
            after, slope_after = value_of(theta + size * move)
            if after >= value + 1e-4 * size * gain or size < 1e-6:
                break
            size /= 2
        if after <= value:
            return theta
        s, y = size * move, slope - slope_after
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        theta, small = theta + s, after - value <= tolerance * (1 + abs(after))
        value, slope = after, slope_after
        if small:
            break
    return theta


def _fit_field(features: np.ndarray, chain: np.ndarray, labels: np.ndarray, least: int = 4, rounds: int = 80, l2: float = 1e-3):
    """Weights by feature, bias and transitions that maximise the token labels' conditional likelihood.

    Features of fewer than ``least`` tokens get no weight, so rare words speak through their beginnings.
    """
    names, index, counts = np.unique(features, return_inverse=True, return_counts=True)
    used = (names != 0) & (counts >= least)
    index = np.where(used, np.cumsum(used), 0)[index.reshape(features.shape)]
    start = np.zeros(int(used.sum()) + 5)
    start[-4] = -6.0
    theta = _ascend(lambda x: likelihood(x, index, chain, labels, l2), start, rounds)
    return names[used], theta[1:-4], theta[-4], np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]])


@dataclass
class ToxicityModel:
    checks: np.ndarray  # upper half of the feature's hash, by slot
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    theta: np.ndarray  # calibration: of the raw evidence, the log of the length, and one

    @staticmethod
    def fit(
        docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_rows: int = 1800, precision: float = 0.5, support: float = 0.004
    ) -> ToxicityModel:
        """Fit on ``max_rows`` rows of ``docs`` with a label in ``labels``, a third of them toxic where so many exist.

        The rows are chosen by label and id, before any text is read.
        """
        known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(label) == 1).alias("toxic"))
        known = stage(known.join(docs.select(F.col(key).alias("key")), "key", "left_semi"), "labelled")
        sizes = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        wanted = {True: max_rows // 3, False: max_rows - max_rows // 3}
        share = {k: min(1.0, wanted[k] / sizes[k]) for k in sizes}
        ordered = known.orderBy(F.xxhash64("key", F.lit("sample")), "key")
        chosen = ordered.where("toxic").limit(wanted[True]).union(ordered.where("not toxic").limit(wanted[False]))
        sample = (
            docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "key")  # at most max_rows
            .groupBy("key", "toxic")
            .agg(F.min("text").alias("text"))
            .orderBy("key")
            .toArrow()
        )
        discard(known)
        prior = sizes.get(True, 0) / max(1, sum(sizes.values()))
        empty = ToxicityModel(np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.float32), -12.0, np.ones((2, 2)), np.array([0, 0, np.log((prior + 1e-3) / (1 - prior + 1e-3))]))
        if len(sizes) < 2:
            return empty
        toxic = np.asarray(sample["toxic"].to_numpy(), bool)
        parts = [(t.first, _tokens(t)) for t in K.slices(sample["text"], _SLICE)]
        features = np.concatenate([t.features for _, t in parts])
        doc = np.concatenate([t.words.doc + first for first, t in parts])
        base = np.cumsum([0] + [len(t.words) for _, t in parts])
        chain = np.append(np.concatenate([t.chain[:-1] + b for b, (_, t) in zip(base, parts, strict=False)]), base[-1])
        weight = np.where(toxic, 1 / share[True], 1 / share[False])
        picked = _cover(features, doc, toxic, weight, precision, support)
        labels = np.isin(features, picked).any(1) & toxic[doc]
        # chains with a toxic token, and as many tokens again several times over without
        hit = np.add.reduceat(labels, chain[:-1]) > 0
        rng = np.random.default_rng(2)
        odds = min(1.0, 8 * np.diff(chain)[hit].sum() / max(1, np.diff(chain)[~hit].sum()))
        hit |= rng.random(len(hit)) < odds
        length = np.diff(chain)[hit]
        inside = np.repeat(hit, np.diff(chain))
        small = np.concatenate([[0], np.cumsum(length)])
        if not labels.any():
            return empty
        names, weights, bias, log_trans = _fit_field(features[inside], small, labels[inside].astype(float))
        checks, slots = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.float32)
        for i in np.argsort(np.abs(weights)):  # of two features in a slot the stronger stays
            at = int(names[i]) & (SLOTS - 1)
            checks[at], slots[at] = int(names[i]) >> 32, weights[i]
        model = ToxicityModel(checks, slots, bias, np.exp(log_trans), np.zeros(3))
        raw = np.concatenate([model._raw(t, _tokens(t))[0] for t in K.slices(sample["text"], _SLICE)])
        # calibration, weighted back to the labelled rows' own proportions
        theta = np.zeros(3)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(raw @ theta, -30, 30)))
            h = weight * p * (1 - p) + 1e-9
            move = np.linalg.solve((raw * h[:, None]).T @ raw + 1e-2 * np.eye(3), raw.T @ (weight * (toxic - p)) - 1e-2 * theta)
            theta = theta + np.clip(move, -1, 1)
            if np.abs(move).max() < 1e-8:
                break
        model.theta = theta
        return model

    def _raw(self, text: K.Text, t: _Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Per document: log odds of a toxic token (bounded on both sides), log length, 1; and all tokens' marginals."""
        unary = np.full(len(t.words), self.bias)
        for k in range(t.features.shape[1]):
            f = t.features[:, k]
            at = (f & np.uint64(SLOTS - 1)).astype(np.intp)
            unary += np.where(self.checks[at] == (f >> np.uint64(32)).astype(np.uint32), self.weights[at], 0)
        p = marginals(unary, t.chain, self.trans)
        sums = np.concatenate([[0.0], np.cumsum(np.where(p >= FAINT, -np.log1p(-np.minimum(p, 0.99)), 0))])
        total = np.maximum(sums[t.words.first[1:]] - sums[t.words.first[:-1]], 0.02)
        evidence = np.clip(np.log(np.expm1(np.minimum(total, 20))), -12, 12)
        return np.stack([evidence, np.log1p(np.diff(t.words.first)), np.ones(len(text))], 1), p

    def _score(self, column: pa.Array) -> pa.Array:
        scores, counts, starts, ends, chances = [], [], [], [], []
        for text in K.slices(column, _SLICE):
            t = _tokens(text)
            raw, p = self._raw(text, t)
            scores.append(1 / (1 + np.exp(-(raw @ self.theta))))
            on = p >= 0.5
            joined = np.zeros(len(on), bool)  # continues the span of the token before
            joined[1:] = on[1:] & on[:-1]
            joined[t.chain[:-1]] = False
            begin = np.flatnonzero(on & ~joined)
            stop = np.flatnonzero(on & ~np.append(joined[1:], False))
            points = K.code_points(text)
            doc = t.words.doc[begin]
            origin = points[text.offsets[doc]]
            starts.append(points[t.words.start[begin]] - origin)
            ends.append(points[t.words.end[stop]] - origin)
            chances.append(np.maximum.reduceat(p, begin)[: len(begin)] if len(begin) else np.zeros(0))
            counts.append(np.bincount(doc, minlength=len(text)))
        flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        spans = pa.StructArray.from_arrays([flat(starts, pa.int64()), flat(ends, pa.int64()), flat(chances, pa.float64())], names=["start", "end", "probability"])
        steps = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype(np.int32)
        return pa.StructArray.from_arrays([flat(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(steps), spans)], names=["score", "spans"])

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``score`` and ``spans`` (code points); columns of these names are replaced."""
        model = docs.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(_SHAPE)
        def scored(column: pa.Array) -> pa.Array:
            return model.value._score(column)

        found = fresh_name(docs, "found")
        kept = without(docs, "score", "spans")
        given = docs.withColumn(found, scored(F.col(f"`{text}`").cast("string")))
        return given.select(*[F.col(f"`{c}`") for c in kept.columns], f"{found}.*")
