"""Toxicity: a linear-chain conditional random field with latent token labels.

Tokens are runs of letters (a-z after lower-casing A-Z, and all bytes from 128). A
token's label says whether it is toxic; only documents are labelled, so token labels
are latent: a document marked toxic has at least one toxic token, any other has none.

Features of a token: the whole word, its byte n-grams of ``GRAMS`` (the word's ends
count as a byte), its shape (length class, capitals), and evidence in the token just
before or after. Of words and n-grams, those that the training texts of label 1 hold
far more often enter the model (likelihood ratio, at most ``FEATURES``); each has a
weight of its own. A token without any of them, and without a neighbour that has,
has the bias alone.

Fit: the all-zero labelling has potential 1, so the probability that no token is toxic
is ``1 / Z``. The weights maximise ``log(1 / Z)`` over clean texts and
``log(NOISE + (1 - NOISE) * (1 - 1 / Z))`` over toxic ones, less a penalty on squares;
``NOISE`` is the chance of a wrong label. The gradients are expectations under the
marginals of forward-backward. Runs of tokens with the bias alone are powers of one
transfer matrix, so a text costs as many steps as it has tokens with evidence; this is
exact. A document's score is ``1 - 1 / Z``, the probability that some token is toxic,
and tokens whose marginal is at least ``OFFENDING`` give the offending byte offsets.

Bounds of the fit: at most ``TRAIN_DOCS`` different labelled texts of each label and
``TRAIN_BYTES`` of text of each (those of least hash). Everything is scored, and
scored texts are used whole. A text that has both labels counts as toxic. Null, empty
and letterless texts score 0, as does everything where no toxic text is labelled.
Repeated rows each give their row; labels of a repeated id count once (the larger);
extra columns are ignored, also those named like the labels' columns.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_bytes, in_text_chunks, least_by_hash, map_arrow, materialize
from .textvec import join_texts, range_hashes, spans

#: Labelled texts of each label, and their bytes, that the model is fitted to.
TRAIN_DOCS = 6000
TRAIN_BYTES = 24 << 20
#: Sizes of byte n-grams.
GRAMS = (4, 5, 6)
#: Toxic training texts that a feature must occur in, and its least likelihood ratio.
LEAST, LEAST_RATIO = 3, 10.0
#: Words and n-grams of the model.
FEATURES = 20_000
#: Chance that a label is wrong, and the penalty on squared weights.
NOISE, PENALTY = 0.01, 0.3
STEPS = 60
#: Tokens with evidence of a block of the fit, and what parts texts by their number of them.
FIT_TOKENS, FIT_CLASSES = 100_000, (17, 65, 257, 1025)
#: Tokens with evidence of a piece of a long text.
PIECE = 64
#: Weight of a feature before the fit, as a multiple of its log odds, and the bias before the fit.
TRUST, BIAS = 2.5, -9.0
#: Of a word's features, those with at least this share of its best one's log odds count.
NEAR = 0.75
#: Marginal from which a token's offsets are reported.
OFFENDING = 0.5
#: Shape features: length classes, capital first, capitals only, evidence before, evidence after.
SHAPES = 8
_HELD = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


class Tokens:
    """Letter runs of some texts, and their different words."""

    def __init__(self, texts: list[bytes]):
        self.buf, self.text_start = join_texts(texts)
        self.start, self.end = spans(_LETTER[self.buf])
        self.first = np.searchsorted(self.start, self.text_start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        upper = np.r_[0, np.cumsum((raw >= 65) & (raw <= 90))]
        self.capital = (raw[self.start] != self.buf[self.start]).astype(np.int8)
        self.capitals = (upper[self.end] - upper[self.start] == self.end - self.start) & (self.end - self.start > 1)
        self.hash = range_hashes(self.buf, self.start, self.end)
        _, at, self.word = np.unique(self.hash, return_index=True, return_inverse=True)
        self.word_start, self.word_end = self.start[at], self.end[at]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the features of the different words, and the word of each."""
        n = self.word_end - self.word_start
        # Every word between two line feeds, which stand for its ends.
        first = np.cumsum(n + 2) - n - 2
        total = int((n + 2).sum())
        own = np.repeat(np.arange(len(n)), n + 2)
        place = np.arange(total) - first[own]
        inside = (place > 0) & (place <= n[own])
        text = np.full(total, 10, np.uint8)
        text[inside] = self.buf[(self.word_start[own] + place - 1)[inside]]
        hashes, owners = [range_hashes(text, first, first + n + 2)], [np.arange(len(n))]
        for size in GRAMS:
            at = np.flatnonzero(place + size <= n[own] + 2)
            at = at[(size < n[own[at]] + 2)]  # the whole word is there already
            hashes.append(range_hashes(text, at, at + size))
            owners.append(own[at])
        return np.concatenate(hashes).view(np.int64), np.concatenate(owners)


@dataclass
class Chains:
    """Tokens with evidence of some texts: ``gap`` tokens before each, features by token, ``tail`` tokens behind the last."""

    first: np.ndarray  # of each text, and the end
    gap: np.ndarray
    tail: np.ndarray
    token: np.ndarray  # of each feature
    feature: np.ndarray  # index of its weight
    value: np.ndarray  # 1, or for words and n-grams one over their number
    at: np.ndarray  # place among all tokens


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted hashes
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the features, before the fit
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SHAPES))  # shapes, then features
    bias: float = 0.0
    edge: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # [0, 0] stays 0

    def __post_init__(self):
        self.quick = np.zeros(1 << 20, bool)
        self.quick[self.features & 0xFFFFF] = True

    def chains(self, tokens: Tokens) -> Chains:
        n = len(tokens.start)
        h, word = tokens.features() if n and len(self.features) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        maybe = np.flatnonzero(self.quick[h & 0xFFFFF])
        h, word = h[maybe], word[maybe]
        at = np.minimum(np.searchsorted(self.features, h), max(0, len(self.features) - 1))
        hit = self.features[at] == h if len(self.features) else np.zeros(0, bool)
        feature, word = at[hit], word[hit]
        pair = np.unique(word * np.int64(len(self.features) + 1) + feature)
        word, feature = pair // (len(self.features) + 1), pair % (len(self.features) + 1)
        best = np.zeros(len(tokens.word_start))
        np.maximum.at(best, word, self.odds[feature])
        strong = self.odds[feature] >= NEAR * best[word]
        word, feature = word[strong], feature[strong]
        times = np.bincount(word, minlength=len(tokens.word_start)) if n else np.zeros(0, np.int64)
        has = times[tokens.word] > 0 if n else np.zeros(0, bool)
        same = tokens.doc[1:] == tokens.doc[:-1]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = has[:-1] & same
        after[:-1] = has[1:] & same
        live = np.flatnonzero(has | before | after)
        first = np.searchsorted(live, tokens.first)
        ends = tokens.first[1:]
        previous = np.r_[0, live[:-1] + 1][: len(live)]
        gap = live - np.maximum(previous, tokens.first[:-1][tokens.doc[live]])
        last = np.where(np.diff(first) > 0, live[np.maximum(first[1:] - 1, 0)] + 1 if len(live) else 0, tokens.first[:-1])
        # Features of the words, spread to their tokens, and shapes of tokens with words of the model.
        start = np.cumsum(times) - times
        per = times[tokens.word[live]] if len(live) else np.zeros(0, np.int64)
        token = np.repeat(np.arange(len(live)), per)
        own = feature[np.repeat(start[tokens.word[live]] - np.cumsum(per) + per, per) + np.arange(len(token))] + SHAPES if len(live) else np.zeros(0, np.int64)
        size = np.clip((tokens.end - tokens.start)[live] // 4, 0, 3)
        kinds = [(has[live], size), (has[live] & (tokens.capital[live] > 0), 4), (has[live] & tokens.capitals[live], 5), (before[live], 6), (after[live], 7)]
        value = 1.0 / np.repeat(per, per)
        token = np.concatenate([token, *(np.flatnonzero(ok) for ok, _ in kinds)])
        own = np.concatenate([own, *(np.broadcast_to(k, len(live))[ok] for ok, k in kinds)])
        value = np.concatenate([value, np.ones(len(own) - len(value))])
        return Chains(first, gap, ends - last, token, own, value, live)

    def node(self, chains: Chains) -> np.ndarray:
        return np.clip(self.bias + np.bincount(chains.token, self.weights[chains.feature] * chains.value, len(chains.gap)), -60, 30)


def _run_powers(bias: float, edge: np.ndarray, lengths: np.ndarray, slopes: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Powers of the transfer matrix of a token with the bias alone, and their derivatives by edges (0,1), (1,0), (1,1)."""
    a = np.exp(edge + np.array([0.0, bias]))
    places = [(0, 1), (1, 0), (1, 1)] if slopes else []
    blocks = []
    for i, j in places or [(0, 0)]:
        block = np.zeros((4, 4))
        block[:2, :2] = block[2:, 2:] = a
        if places:
            block[i, 2 + j] = a[i, j]
        blocks.append(block)
    power = np.stack(blocks)[:, None]
    out = np.broadcast_to(np.eye(4), (len(blocks), len(lengths), 4, 4)).copy()
    left = lengths.copy()
    while left.any():
        odd = left & 1 == 1
        out[:, odd] = out[:, odd] @ power
        power, left = power @ power, left >> 1
    return out[0, :, :2, :2], [out[k, :, :2, 2:] for k in range(len(places))]


def _product(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Products of 2 by 2 matrices, given as four arrays."""
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]]


class _Lanes:
    """Pieces of unequal length that advance together: their places by step, the longest pieces first."""

    def __init__(self, first: np.ndarray, size: np.ndarray):
        self.order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[self.order], -np.arange(int(size.max(initial=0))), "left")
        begin = np.cumsum(live) - live
        step = np.repeat(np.arange(len(live)), live)
        self.place = first[self.order][np.arange(len(step)) - begin[step]] + step
        self.steps = list(zip(begin.tolist(), (begin + live).tolist(), strict=True))


def _messages(m: list[np.ndarray], lanes: _Lanes, ahead: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each place its scale and the normalised messages before it (2) and behind it (2); ``ahead`` and ``after`` are those of the pieces' ends."""
    m00, m01, m10, m11 = (x[lanes.place] for x in m)
    n = len(lanes.place)
    scale, a0, a1, b0, b1 = np.ones(n), *(np.empty(n) for _ in range(4))
    v0, v1 = ahead[lanes.order].T.copy()
    for s, e in lanes.steps:
        x, y = a0[s:e], a1[s:e]
        x[:], y[:] = v0[: e - s], v1[: e - s]
        to0, to1 = x * m00[s:e] + y * m10[s:e], x * m01[s:e] + y * m11[s:e]
        total = np.add(to0, to1, out=scale[s:e])
        v0[: e - s], v1[: e - s] = to0 / total, to1 / total
    w0, w1 = after[lanes.order].T.copy()
    for s, e in reversed(lanes.steps):
        x, y = b0[s:e], b1[s:e]
        x[:], y[:] = w0[: e - s], w1[: e - s]
        to0, to1 = m00[s:e] * x + m01[s:e] * y, m10[s:e] * x + m11[s:e] * y
        total = to0 + to1
        w0[: e - s], w1[: e - s] = to0 / total, to1 / total
    out = []
    for x in (scale, a0, a1, b0, b1):
        back = np.empty(n)
        back[lanes.place] = x
        out.append(back)
    return tuple(out)


def _all_messages(m: list[np.ndarray], first: np.ndarray, size: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_messages`` of texts that begin with the label 0.

    Long texts are cut into pieces of ``PIECE`` tokens. The pieces' matrices are
    multiplied first, all pieces at a time, and give the messages at their ends.
    """
    ahead = np.tile([1.0, 0.0], (len(size), 1))
    if int(size.max(initial=0)) <= PIECE:
        return _messages(m, _Lanes(first, size), ahead, after)
    pieces = -(-size // PIECE)
    text = np.repeat(np.arange(len(size)), pieces)
    number = np.cumsum(pieces) - pieces  # of each text's first piece
    k = np.arange(len(text)) - number[text]
    own_first, own_size = first[text] + k * PIECE, np.minimum(PIECE, size[text] - k * PIECE)
    many = np.flatnonzero(pieces[text] > 1)
    lanes = _Lanes(own_first[many], own_size[many])
    whole = [np.full(len(many), x) for x in (1.0, 0.0, 0.0, 1.0)]
    at = [x[lanes.place] for x in m]
    for s, e in lanes.steps:
        now = _product([x[: e - s] for x in whole], [x[s:e] for x in at])
        total = now[0] + now[1] + now[2] + now[3]
        for x, y in zip(whole, now, strict=True):
            x[: e - s] = y / total
    product = [np.full(len(text), x) for x in (1.0, 0.0, 0.0, 1.0)]
    for x, y in zip(product, whole, strict=True):
        x[many[lanes.order]] = y
    _, a0, a1, b0, b1 = _messages(product, _Lanes(number, pieces), ahead, after)
    return _messages(m, _Lanes(own_first, own_size), np.stack([a0, a1], axis=1), np.stack([b0, b1], axis=1))


def forward_backward(chains: Chains, node: np.ndarray, bias: float, edge: np.ndarray, slopes: bool = False):
    """log Z of each text and P(label 1) of each token with evidence.

    With ``slopes`` also, for each text, the expected number of toxic tokens that have
    the bias alone, and of the pairs (0,1), (1,0), (1,1) of labels; the label before
    the first token counts as 0.
    """
    docs, count = len(chains.tail), np.diff(chains.first)
    held = np.bincount(np.r_[chains.gap, chains.tail].astype(np.int64)) > 0
    lengths, of = np.flatnonzero(held), np.cumsum(held) - 1
    runs, slope = _run_powers(bias, edge, lengths, slopes)
    gap, tail = of[chains.gap.astype(np.int64)], of[chains.tail.astype(np.int64)]
    toxic, edges = np.exp(node), np.exp(edge)
    run = [runs[:, i, j][gap] for i in (0, 1) for j in (0, 1)]
    own = [np.full(len(node), edges[0, 0]), edges[0, 1] * toxic, np.full(len(node), edges[1, 0]), edges[1, 1] * toxic]
    back = runs[tail].sum(axis=2)
    scale, a0, a1, b0, b1 = _all_messages(_product(run, own), chains.first[:-1], count, back / back.sum(axis=1, keepdims=True))
    owner = np.repeat(np.arange(docs), count)
    into0, into1 = a0 * run[0] + a1 * run[2], a0 * run[1] + a1 * run[3]
    joint = [into0 * own[0] * b0, into0 * own[1] * b1, into1 * own[2] * b0, into1 * own[3] * b1]
    total = joint[0] + joint[1] + joint[2] + joint[3]
    joint = [x / total for x in joint]
    p = joint[1] + joint[3]
    # The message behind the last token with evidence.
    last, some = np.tile([1.0, 0.0], (docs, 1)), count > 0
    i = chains.first[1:][some] - 1
    last[some] = np.stack([into0 * own[0] + into1 * own[2], into0 * own[1] + into1 * own[3]], axis=1)[i] / scale[i, None]
    log_z = np.bincount(owner, np.log(scale), docs) + np.log((last * back).sum(axis=1))
    if not slopes:
        return log_z, p
    expected = np.stack([np.zeros(docs), *(np.bincount(owner, x, docs) for x in joint[1:])], axis=1)

    def in_run(to, x, y, which, f, g):
        """Adds what runs hold between the messages ``x, y`` ahead of and ``f, g`` after them."""
        outer = [x * f, x * g, y * f, y * g]
        inner = lambda s: sum(s[:, i, j][which] * outer[2 * i + j] for i in (0, 1) for j in (0, 1))
        whole = inner(runs)
        part = [np.bincount(to, inner(s) / whole, docs) for s in slope]
        expected[:, 0] += part[0] + part[2]
        expected[:, 1:] += np.stack(part, axis=1)

    i = np.flatnonzero(chains.gap)  # no gap holds nothing
    in_run(owner[i], a0[i], a1[i], gap[i], (own[0] * b0 + own[1] * b1)[i], (own[2] * b0 + own[3] * b1)[i])
    in_run(np.arange(docs), *last.T, tail, np.ones(docs), np.ones(docs))
    return log_z, p, expected


def _packed(model: Model) -> np.ndarray:
    return np.concatenate([model.weights, [model.bias], model.edge.ravel()[1:]])


def _unpacked(model: Model, w: np.ndarray) -> Model:
    """``model`` with the weights, bias and edges of ``w``."""
    k, out = len(model.weights), copy.copy(model)
    out.weights, out.bias, out.edge = w[:k], float(w[k]), np.r_[0.0, w[k + 1 :]].reshape(2, 2)
    return out


def slope_of(model: Model, chains: Chains, toxic: np.ndarray) -> np.ndarray:
    """What some texts and their labels (1: toxic) add to the slope of the likelihood at ``model``."""
    owner = np.repeat(np.arange(len(chains.tail)), np.diff(chains.first))
    log_z, p, expected = forward_backward(chains, model.node(chains), model.bias, model.edge, slopes=True)
    none = np.exp(-np.maximum(log_z, 0))
    pull = np.where(toxic, (1 - NOISE) * none / (NOISE + (1 - NOISE) * (1 - none)), -1.0)
    given = p * pull[owner]
    return np.concatenate([np.bincount(chains.feature, given[chains.token] * chains.value, len(model.weights)), [given.sum() + pull @ expected[:, 0]], pull @ expected[:, 1:]])


def climb(model: Model, slope: Callable[[Model], np.ndarray], steps: int = STEPS) -> Model:
    """The model after gradient steps of adapted size (RPROP); ``slope`` is that of the likelihood.

    The penalty draws weights to those that the model comes with, so that a word that
    always stands beside others like it keeps what it is worth by itself.
    """
    w = _packed(model)
    prior, rate, last = w.copy(), np.full(len(w), 0.2), np.zeros(len(w))
    for _ in range(steps):
        now = slope(_unpacked(model, w)) - PENALTY * (w - prior)
        turn = now * last
        rate = np.clip(np.where(turn > 0, rate * 1.2, np.where(turn < 0, rate * 0.5, rate)), 1e-5, 0.5)
        now = np.where(turn < 0, 0.0, now)
        w, last = np.clip(w + np.sign(now) * rate, -25, 25), now
    return _unpacked(model, w)


def fit(model: Model, chains: Chains, toxic: np.ndarray, steps: int = STEPS) -> None:
    """Fit the weights to texts held as one block."""
    model.__dict__.update(climb(model, lambda m: slope_of(m, chains, toxic), steps).__dict__)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, body``: different texts, of each label those of least hash within the bounds.

    They are chosen by id and hash; only the chosen rows' texts move.
    """
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    hashed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    once = hashed.join(marked, "_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min(F.struct("_id", "size")).alias("one"))
    once = materialize(once.select("h", "toxic", F.col("one._id").alias("_id"), F.col("one.size").alias("size")), "toxic-texts")
    n = {r.toxic: r["count"] for r in once.groupBy("toxic").count().collect()}
    least = [least_by_hash(once.where(F.col("toxic") == k), F.col("h"), TRAIN_DOCS, n.get(k, 0)) for k in (0, 1)]
    chosen = least[0].union(least[1])  # at most 2 * TRAIN_DOCS rows
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy("h", "_id"))
    chosen = materialize(chosen.withColumn("so_far", so_far).where(F.col("so_far") <= TRAIN_BYTES).select("_id", F.col("h").alias("_h"), "toxic"), "toxic-chosen")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return rows.join(F.broadcast(chosen), ["_id", "_h"]).dropDuplicates(["_id", "_h"]).select("toxic", "body")


def _counts(sample: DataFrame) -> DataFrame:
    """``feature, n0, n1``: texts of each label that hold it; every task combines its own."""

    def make():
        def run(batches):
            parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0

            def combined():
                f, a, b = (np.concatenate([p[i] for p in parts]) for i in range(3))
                f, at = np.unique(f, return_inverse=True)
                return f, np.bincount(at, a, len(f)).astype(np.int64), np.bincount(at, b, len(f)).astype(np.int64)

            def flush():
                f, a, b = parts[0]
                for i in range(0, len(f), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (f, a, b)], ["feature", "n0", "n1"])

            for labels, texts in in_text_chunks(batches, 256 << 10):
                tokens = Tokens(texts)
                if not len(tokens.start):
                    continue
                h, word = tokens.features()
                h, at = np.unique(h, return_inverse=True)
                pair = np.unique(tokens.doc * np.int64(len(tokens.word_start)) + tokens.word)
                doc, used = pair // len(tokens.word_start), pair % len(tokens.word_start)
                # (text, feature) pairs by way of the words of each text.
                order = np.argsort(word, kind="stable")
                times = np.bincount(word, minlength=len(tokens.word_start))
                start = np.cumsum(times) - times
                per = times[used]
                which = at[order[np.repeat(start[used] - np.cumsum(per) + per, per) + np.arange(per.sum())]]
                both = np.unique(np.repeat(doc, per) * np.int64(len(h)) + which)
                toxic = np.asarray(labels, np.int64)[both // len(h)]
                n1 = np.bincount(both % len(h), toxic, len(h)).astype(np.int64)
                n = np.bincount(both % len(h), minlength=len(h))
                parts.append((h, n - n1, n1))
                size += len(h)
                if size > _HELD:
                    parts[:] = [combined()]
                    size = len(parts[0][0])
                    if size > _HELD // 2:
                        yield from flush()
                        parts.clear()
                        size = 0
            if parts:
                parts[:] = [combined()]
                yield from flush()

        return run

    return map_arrow(sample, make, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _fitted(sample: DataFrame, unfitted: Model) -> Model:
    """The model fitted to the sample's tokens with evidence.

    Texts of about as many such tokens are rows of a table together, the longest ones in
    one place, since a text costs as many steps as it has of them and texts of like
    length share these. Each step of the fit is a job over the table: every task sums
    the slopes of its blocks, one after the other, and sends the sum; the driver adds
    those of the tasks and moves the weights.
    """
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(unfitted)  # FEATURES hashes and weights
    names, kinds = ["count", "gap", "tail", "times", "feature", "value"], ["<i4"] * 5 + ["<f4"]

    def make_chains():
        model = shared.value

        def run(batches):
            for labels, texts in in_text_chunks(batches):
                c = model.chains(Tokens(texts))
                order = np.argsort(c.token, kind="stable")
                count, times, toxic = np.diff(c.first), np.bincount(c.token, minlength=len(c.gap)), np.array(labels, np.int8)
                kind = np.digitize(count, FIT_CLASSES)
                of_token = np.repeat(kind, count)
                of_feature = np.repeat(of_token, times)
                for k in np.unique(kind):
                    doc, token, feature = kind == k, of_token == k, of_feature == k
                    values = [count[doc], c.gap[token], c.tail[doc], times[token], c.feature[order][feature], c.value[order][feature]]
                    yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([toxic[doc].tobytes()]), *(pa.array([v.astype(t).tobytes()]) for v, t in zip(values, kinds, strict=True))], ["kind", "toxic", *names])

        return run

    rows = map_arrow(sample, make_chains, "kind int, toxic binary, " + ", ".join(f"{k} binary" for k in names))
    rows = materialize(rows, "toxic-chains")
    tokens = {r.kind: r.n for r in rows.groupBy("kind").agg(F.sum(F.octet_length("gap") / 4).alias("n")).collect()}
    place, parts = F.lit(0), 0
    for k in sorted(tokens):  # as few tasks for each length as its tokens need
        n = 1 + int(tokens[k]) // (4 * FIT_TOKENS)
        place = F.when(F.col("kind") == k, parts + F.pmod(F.xxhash64("feature", "gap"), F.lit(n))).otherwise(place)
        parts += n
    rows = materialize(rows.repartitionById(max(1, parts), place.cast("int")), "toxic-blocks")

    def slope(model: Model) -> np.ndarray:
        w = spark.sparkContext.broadcast(_packed(model))

        def make_slope():
            now = _unpacked(shared.value, w.value)

            def block(held: list[dict]) -> np.ndarray:
                *counts, value = (np.concatenate([np.frombuffer(r[k], kind) for r in held]) for k, kind in zip(names, kinds, strict=True))
                count, gap, tail, times, feature = (x.astype(np.int64) for x in counts)
                chains = Chains(np.r_[0, np.cumsum(count)], gap, tail, np.repeat(np.arange(len(gap)), times), feature, value.astype(np.float64), np.zeros(0, np.int64))
                return slope_of(now, chains, np.concatenate([np.frombuffer(r["toxic"], np.int8) for r in held]) == 1)

            def run(batches):
                total = np.zeros(len(w.value))
                held: dict[int, list] = {}
                for batch in batches:
                    for row in batch.to_pylist():
                        mine = held.setdefault(row["kind"], [])
                        mine.append(row)
                        if sum(len(r["gap"]) for r in mine) >= 4 * FIT_TOKENS:
                            total += block(held.pop(row["kind"]))
                for k in sorted(held):
                    total += block(held[k])
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["slope"])

            return run

        sums = map_arrow(rows, make_slope, "slope binary").collect()  # a row of FEATURES numbers for each task
        w.unpersist()
        return np.sum([np.frombuffer(r.slope) for r in sums], axis=0) if sums else np.zeros(len(_packed(model)))

    return climb(unfitted, slope)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model fitted to ``docs`` (text) with ``labels`` (toxic) of the same doc_id."""
    sample = materialize(_sample(docs, labels), "toxic-sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1):
        return Model()
    n1, n0 = float(n[1]), float(n.get(0, 0))
    one, zero = F.col("n1") + 0.0, F.col("n0") + 0.0
    # Likelihood ratio of the label given the feature; log odds with half a text added on either side.
    part = lambda x, of: F.when(x > 0, x * F.log(x / ((one + zero) * of / (n1 + n0)))).otherwise(0.0)
    odds = F.log((one + 0.5) / (n1 + 1)) - F.log((zero + 0.5) / (n0 + 1)) - 2 * F.sqrt(1 / (one + 0.5) + 1 / (zero + 0.5))  # the lower end of an interval
    counted = _counts(sample).where(F.col("n1") >= LEAST).select("feature", (2 * (part(one, F.lit(n1)) + part(zero, F.lit(n0)))).alias("ratio"), odds.alias("odds"))
    best = counted.where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") > 0)).orderBy(F.desc("ratio"), "feature").limit(FEATURES).toPandas().sort_values("feature")
    if not len(best):
        return Model()
    model = Model(best.feature.to_numpy(np.int64), best.odds.to_numpy(), np.concatenate([np.zeros(SHAPES), TRUST * best.odds.to_numpy()]), BIAS)
    return _fitted(sample, model)


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, spans``; spans are byte offsets of offending tokens with their probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES hashes and weights

    def make():
        m = shared.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

        def run(batches):
            for ids, texts in in_text_chunks(batches):
                tokens = Tokens(texts)
                scores, found = np.zeros(len(texts)), [[] for _ in texts]
                if len(m.features) and len(tokens.start):
                    chains = m.chains(tokens)
                    log_z, p = forward_backward(chains, m.node(chains), m.bias, m.edge)
                    scores = -np.expm1(-np.maximum(log_z, 0))
                    for i in np.flatnonzero(p >= OFFENDING):
                        t = chains.at[i]
                        d = tokens.doc[t]
                        found[d].append({"start": int(tokens.start[t] - tokens.text_start[d]), "end": int(tokens.end[t] - tokens.text_start[d]), "p": float(p[i])})
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores), pa.array(found, span)], ["doc_id", "score", "spans"])

        return run

    return map_arrow(doc_bytes(docs), make, "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>")
