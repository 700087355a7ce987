"""LM scoring with a hierarchical Pitman-Yor model over preceding words.

A text is its words and one end; the context of a token are the two tokens before it
(starts of text where there are fewer). Restaurants of two and of one preceding word
hand each of their tables to the restaurant of the shorter context; tables of the
one-word restaurants are the customers of the word restaurant, whose base measure
spells words (``pitman_yor``). All counts are of the whole training corpus.

A sweep draws the table count of every dish anew, given the other tables of its
restaurant and the shorter context's probability (``draw_tables``), from the longest
contexts to the shortest. Dishes of one level move at once. ``BURN_IN`` sweeps are
thrown away, ``SAMPLES`` predictive probabilities are averaged. Random numbers follow
from a dish's hash, so scores do not depend on how the rows lie.

How it is dealt: tokens go with their contexts to the bucket of the preceding word, as
all restaurants that hand tables to it end in that word. The one-word restaurant of a
very frequent word is dealt as shares by the word before it (at the start of a text:
by document); each share is a restaurant of its own under the same parent, and the
two-word restaurants stay whole. A first round of buckets gives the customers of the
word restaurant, a second one, which knows the word probabilities, scores. Words are
told apart by 48 bits of hash. Frequent words go as numbers (``Codes``), and their
customers and probabilities as arrays; other words as hashes, and in rows.

A null or empty text has the end alone. Texts are used whole. Rows with the same id
are scored each. Without training texts every token has the base score's probability
of an unseen one. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pitman_yor as py
from .common import forget, in_runs, joined, map_arrow, materialize, shuffle_partitions
from .seating import draw_tables
from .textvec import Words, mix

#: Preceding words of the longest context.
ORDER = 2
#: Sweeps of the first round; sweeps thrown away and samples of the second.
LEARN, BURN_IN, SAMPLES = 3, 3, 3
#: Discounts of two-word and one-word contexts.
DISCOUNTS = (0.8, 0.75)
#: Tokens that a bucket should hold, occurrences of a preceding word in one share.
BUCKET_TOKENS = 500_000
SHARE_TOKENS = 1_000_000
#: Words that are looked at for shares, the most frequent ones.
HOT = 1 << 20
#: Words of at least one in so many training tokens (so at most that many) have numbers.
CODED = 1 << 22
#: Words whose answers are packed together.
ANSWERS = 50_000
#: Numbers whose tables are added up as one row.
CHUNK = 1 << 14
RUN_BYTES = 4 << 20
_U = np.uint64
_START, _END = _U(0x1B873593CC9E), _U(0x85EBCA6BC2B2)
_BITS = _U(16)


def _fold(*parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), _U)
    for part in parts:
        h = mix(h * _U(0xC2B2AE3D27D4EB4F) + part)
    return h


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values, where each is first, and the number of each one's value in 32 bits (``np.unique`` takes twice that, twice)."""
    order = np.argsort(h)  # not stable, which is faster
    own = h[order]
    new = np.ones(len(h), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    own = own[new]
    first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(h) else order
    at = np.empty(len(h), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return own, first, at


class Contexts:
    """The restaurants of tokens ``w`` after ``y, z``; ``train`` tokens are customers.

    Levels go from the longest contexts to the shortest. Dishes without customers are
    kept, as tokens to score look them up.
    """

    def __init__(self, y: np.ndarray, z: np.ndarray, w: np.ndarray, train: np.ndarray):
        self.at, self.rest, self.n, self.t, self.busy, self.key = [], [], [], [], [], []
        count, context = train.astype(np.int32), [y, z]
        for _ in range(ORDER):
            key, first, at = _distinct(_fold(*context, w))
            count = np.bincount(at, count, len(first)).astype(np.int32)
            context, w = [c[first] for c in context], w[first]
            self.at.append(at)
            self.rest.append(_distinct(_fold(*context))[2])
            self.n.append(count)
            self.t.append(np.minimum(count, 1))
            self.key.append(key)
            context = context[1:]
            count = self.t[-1]
        self.w = w
        self.busy = [np.flatnonzero(n > 1) for n in self.n]
        # Dishes of the longest contexts with at most one customer stay as they are: their tables by restaurant and parent.
        still = self.t[0].copy()
        still[self.busy[0]] = 0
        self.still = [np.bincount(at, still).astype(np.int32) for at in (self.rest[0], self.at[1])]

    def up(self, k: int) -> np.ndarray:
        """The dish of the shorter context."""
        return self.at[k + 1]

    def _at_level(self, k: int, which, parent: np.ndarray) -> np.ndarray:
        """Probabilities of dishes ``which``, for which the shorter contexts give ``parent``."""
        customers, tables = np.bincount(self.rest[k], self.n[k]), np.bincount(self.rest[k], self.t[k])
        rest, n, t = self.rest[k][which], self.n[k][which], self.t[k][which]
        return (n - DISCOUNTS[k] * t + (py.STRENGTH + DISCOUNTS[k] * tables[rest]) * parent) / (py.STRENGTH + customers[rest])

    def predictive(self, p: np.ndarray) -> list[np.ndarray]:
        """Probabilities of the dishes of each level and, last, ``p`` of the words."""
        out = [p]
        for k in range(ORDER - 1, -1, -1):
            out.insert(0, self._at_level(k, slice(None), out[0] if k == ORDER - 1 else out[0][self.up(k)]))
        return out

    def _tables_of_busy(self, to: np.ndarray, still: np.ndarray) -> np.ndarray:
        """Tables of the longest contexts, added up by ``to``."""
        i = self.busy[0]
        return still + np.bincount(to[i], self.t[0][i], len(still))

    def sweep(self, p: np.ndarray, number: int) -> None:
        """Every customer of every dish sits down anew."""
        asked = self.up(0)[self.busy[0]]
        parents = [self._at_level(1, asked, p[asked]), None]
        for k in range(ORDER):
            if k:
                self.n[k] = self._tables_of_busy(self.at[k], self.still[1]).astype(np.int32)
                self.busy[k] = np.flatnonzero(self.n[k] > 1)
                parents[k] = p[self.busy[k]]
            i = self.busy[k]
            tables = np.bincount(self.rest[k], self.t[k]) if k else self._tables_of_busy(self.rest[k], self.still[0])
            others = py.STRENGTH + DISCOUNTS[k] * (tables[self.rest[k][i]] - self.t[k][i])
            self.t[k] = np.minimum(self.n[k], 1)
            self.t[k][i] = draw_tables(self.n[k][i], others, parents[k], DISCOUNTS[k], self.key[k][i], number)


_NAMES = ["bucket", "kind", "run", "a"]
_SHAPE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("run", pa.int64()), ("a", pa.binary())])
_DEALT = "bucket int, kind int, run long, a binary"


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes (numbers of the same place together), compressed."""
    import zstandard

    planes = []
    for x in arrays:
        planes.append(np.array([len(x), x.dtype.itemsize], "<u4").tobytes())
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _opened(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        n, size = np.frombuffer(raw, "<u4", 2, at).tolist()
        plane = np.frombuffer(raw, np.uint8, n * size, at + 8).reshape(size, n)
        at += 8 + n * size
        wide = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        wide[:, :size] = plane.T
        out.append(wide.view(kind).ravel())
    return out


def _least_width(x: np.ndarray) -> np.ndarray:
    return x.astype("<u2" if not len(x) or int(x.max()) < 1 << 16 else "<u4")


class Shares:
    """In how many shares the occurrences of a preceding word are dealt."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, starts: int):
        order = np.argsort(words)
        self.words, self.shares = words[order], -(-counts[order] // SHARE_TOKENS)
        self.starts = max(1, -(-starts // SHARE_TOKENS))

    def split(self, y: np.ndarray, z: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """``z`` with its share in it; ``doc`` is a hash of the document."""
        out = z.copy()
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, z), len(self.words) - 1)
            i = np.flatnonzero(self.words[at] == z)
            by = np.where(y[i] == _START, mix(doc[i]), mix(y[i]))
            out[i] = _fold(z[i], by % self.shares[at[i]].astype(_U)) >> _BITS
        if self.starts > 1:
            i = np.flatnonzero(z == _START)
            out[i] = _fold(z[i], mix(doc[i]) % _U(self.starts)) >> _BITS
        return out


class Codes:
    """Numbers of frequent words, from 1; 0 is any other word. As preceding words they also have a number in their bucket."""

    def __init__(self, frequent: np.ndarray, shares: Shares, buckets: int):
        dealt = [np.array([_START, _END], _U)]
        for z, n in zip([*shares.words, _START], [*shares.shares.tolist(), shares.starts], strict=True):
            if n > 1:
                dealt.append(_fold(np.full(n, z, _U), np.arange(n, dtype=_U)) >> _BITS)
        words = np.concatenate([*dealt, frequent])
        self.mask = _U((1 << max(10, (8 * len(words)).bit_length())) - 1)
        _, first = np.unique(words & self.mask, return_index=True)  # of words with the same slot, the first has a number
        words = words[np.sort(first)]
        self.words = np.r_[_U(0), words]
        self.slot = np.zeros(int(self.mask) + 1, np.int32)
        self.slot[words & self.mask] = np.arange(1, len(self.words), dtype=np.int32)
        bucket = (mix(self.words) % _U(buckets)).astype(np.int64)
        bucket[0] = buckets
        self.order = np.argsort(bucket, kind="stable")
        self.first = np.searchsorted(bucket[self.order], np.arange(buckets + 1))
        self.rank = np.zeros(len(self.words), np.int32)
        self.rank[self.order] = np.arange(1, len(self.words) + 1) - self.first[bucket[self.order]]
        self.rank[0] = 0

    def of(self, h: np.ndarray) -> np.ndarray:
        code = self.slot[h & self.mask]
        code[self.words[code] != h] = 0
        return code

    def preceding(self, bucket: int) -> np.ndarray:
        """Words by their number in the bucket."""
        return np.r_[_U(0), self.words[self.order[self.first[bucket] : self.first[bucket + 1]]]]


def _six(h: np.ndarray) -> np.ndarray:
    """Words' hashes without the two bytes that are 0."""
    return np.ascontiguousarray(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def _deal(rows: DataFrame, buckets: int, shares: Shares, codes, base=None) -> DataFrame:
    """Runs of texts by the bucket of preceding words; kind 0: tokens, kind 2: the run's documents.

    ``body`` has one more byte before the text: whether it is trained on. ``codes`` is a
    broadcast, and so is ``base``: counts and base scores by the words' numbers, which
    the run's documents have in sums. Without it, tokens are dealt without their documents.
    """
    shared = rows.sparkSession.sparkContext.broadcast(shares)  # HOT words at most

    def make():
        from pyspark import TaskContext

        share, code = shared.value, codes.value
        counts, scores = base.value if base else (None, None)

        def run(batches):
            number = TaskContext.get().partitionId() << 32
            for ids, bodies in in_runs(batches, RUN_BYTES):
                number += 1
                yield from one(number, ids, bodies)

        def one(number, ids, bodies):
            train = np.array([b[:1] == b"1" for b in bodies])
            words = Words([b[1:] for b in bodies])
            n = words.count + 1
            doc = np.repeat(np.arange(len(ids)), n)
            ends = np.cumsum(n) - 1
            h = np.full(len(doc), _END, _U)
            h[np.arange(len(words.doc)) + words.doc] = words.hashes() >> _BITS
            del words
            place = np.arange(len(doc)) - (ends - n + 1)[doc]

            def before(x, start):
                return np.where(place >= 1, np.r_[start, x[:-1]].astype(x.dtype), start.astype(x.dtype))

            z = before(h, _START)
            y = before(z, _START)
            w_code = code.of(h)
            start = code.of(np.array([_START]))[0]
            y_code = before(before(w_code, start), start)
            known = mix(np.array([(i or 0) & (2**64 - 1) for i in ids], _U))
            z = share.split(y, z, known[doc])
            z_code = code.rank[code.of(z)]
            bucket = (mix(z) % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            bucket, doc, h, y, z, w_code, y_code, z_code = (x[order] for x in (bucket, doc, h, y, z, w_code, y_code, z_code))
            train = train[doc].astype(np.uint8)
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            if base:
                known, score = (np.bincount(doc, x[w_code], len(ids)) for x in (counts > 0, scores))
                facts = (np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], np.uint8), n.astype("<i8"), known.astype("<i8"), score.astype("<f8"))
                yield pa.RecordBatch.from_pydict({"bucket": [number % buckets], "kind": [2], "run": [number], "a": [_squeezed(*facts)]}, schema=_SHAPE)
            rows_ = {k: [] for k in _NAMES}
            for b, s, e in zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(doc)], strict=True):
                at, parts = slice(s, e), []
                for own, value in ((w_code, h), (y_code, y), (z_code, z)):
                    parts += [_least_width(own[at]), _six(value[at][own[at] == 0])]
                texts = _least_width(np.diff(doc[at], prepend=0)) if base else np.zeros(0, "<u2")
                for k, v in zip(_NAMES, (b, 0, number, _squeezed(*parts, texts, train[at])), strict=True):
                    rows_[k].append(v)
            yield pa.RecordBatch.from_pydict(rows_, schema=_SHAPE)

        return run

    return map_arrow(rows, make, _DEALT)


def _read(batches, codes: Codes):
    """Contexts of the bucket's tokens, ``(run, doc)`` of each run, known words ``(w, c, p)`` and heads."""
    parts, runs, known, heads = [[] for _ in range(4)], [], [], []
    preceding = {}
    for batch in batches:
        for bucket, kind, number, a in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == 2:
                heads.append((number, a))
            elif kind == 1:
                known.append(_opened(a, "<u8", "<i8", "<f8"))
            else:
                if bucket not in preceding:
                    preceding[bucket] = codes.preceding(bucket)
                w, w_else, y, y_else, z, z_else, doc, train = _opened(a, *["<u4", "<u8"] * 3, "<u4", "u1")
                for part, words, own, rest in zip(parts, (codes.words, preceding[bucket], codes.words), (y, z, w), (y_else, z_else, w_else), strict=False):
                    h = words[own]
                    h[own == 0] = rest
                    part.append(h)
                parts[3].append(train)
                runs.append((number, np.cumsum(doc, dtype=np.int32)))
    if not runs:
        return None, [], known, heads
    for part in parts:  # one column at a time is held twice
        part[:] = [np.concatenate(part)]
    return Contexts(*(part.pop() for part in parts)), runs, known, heads


def _learn(dealt: DataFrame, buckets: int, words: int, codes) -> DataFrame:
    """Tables of the one-word restaurants of a bucket for each word.

    Of frequent words ``w`` is a chunk of numbers and ``packed`` has the numbers and
    tables; others have a row each, ``w, bucket, n``, with 0 for words of texts that
    are not trained on.
    """

    def make():
        code = codes.value
        shape = pa.schema([("w", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("packed", pa.binary())])

        def run(batches):
            kept = list(batches)
            of = np.unique(np.concatenate([np.asarray(b.column(0)) for b in kept] or [np.zeros(0, np.int32)]))
            model, _, _, _ = _read(kept, code)
            del kept
            if model is None:
                return
            p = np.full(len(model.w), 1 / (words + 2))
            for k in range(LEARN):
                model.sweep(p, k)
            own = code.of(model.w)
            total = np.bincount(own, model.t[-1], len(code.words)).astype(np.int64)
            total[0] = 0
            for chunk in range(0, len(total), CHUNK):
                part = total[chunk : chunk + CHUNK]
                at = np.flatnonzero(part)
                if len(at):
                    yield pa.RecordBatch.from_pydict({"w": [chunk // CHUNK], "bucket": [None], "n": [None], "packed": [_squeezed(at.astype("<u2"), part[at])]}, schema=shape)
            rare = own == 0
            w, at = np.unique(model.w[rare], return_inverse=True)
            n = np.bincount(at, model.t[-1][rare], len(w)).astype(np.int64)
            # Every bucket of the task (one, unless Spark joins small ones) asks for these words.
            for b in of.tolist():
                for i in range(0, len(w), 100_000):
                    part = w[i : i + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), b, np.int32)), pa.array(n[i : i + 100_000]), pa.nulls(len(part), pa.binary())], schema=shape)
                n = np.zeros_like(n)

        return run

    return map_arrow(dealt.repartitionById(buckets, "bucket"), make, "w long, bucket int, n long, packed binary")


def _customers(tables: DataFrame, codes, parts: int) -> DataFrame:
    """``w, c, buckets``: customers of the words, and which buckets ask for those that have no number."""

    def make():
        code = codes.value

        def run(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    at, n = _opened(packed, "<u2", "<i8")
                    total.setdefault(chunk, np.zeros(CHUNK, np.int64))[at] += n
            for chunk, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(code.words[at + chunk * CHUNK].view(np.int64)), pa.array(n[at])], ["w", "c"])

        return run

    coded = map_arrow(tables.where("packed IS NOT NULL").select("w", "packed").repartition(parts, "w"), make, "w long, c long")
    rare = tables.where("packed IS NULL").groupBy("w").agg(F.sum("n").alias("c"), F.collect_list("bucket").alias("buckets"))
    return rare.unionByName(coded.withColumn("buckets", F.lit(None).cast("array<int>")))


def _answers(words: DataFrame) -> DataFrame:
    """kind 1: for each bucket its words with count and probability, of ``w, raw, p, buckets``; packed by task."""

    def make():
        def run(batches):
            for batch in joined(batches, ANSWERS):
                w, c, p = (np.asarray(batch.column(i)) for i in range(3))
                lists = batch.column(3)
                bucket = np.asarray(lists.flatten())
                at = np.repeat(np.arange(len(w)), np.diff(np.asarray(lists.offsets)))
                order = np.argsort(bucket, kind="stable")
                bucket, at = bucket[order], at[order]
                which, first = np.unique(bucket, return_index=True)
                rows = {k: [] for k in _NAMES}
                for b, s, e in zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                    i = at[s:e]
                    for k, v in zip(_NAMES, (b, 1, 0, _squeezed(_six(w[i]), c[i], p[i])), strict=True):
                        rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=_SHAPE)

        return run

    return map_arrow(words.select("w", "raw", "p", "buckets"), make, _DEALT)


def _score(dealt: DataFrame, buckets: int, base_scale: float, unseen: float, codes, frequent) -> DataFrame:
    """``run, kind, a``: kind 0: documents of a run with model sums, and known tokens and base sums of words without number; kind 2: heads.

    ``frequent`` is a broadcast of probabilities by the words' numbers.
    """

    def make():
        code, chances = codes.value, frequent.value
        shape = pa.schema([("run", pa.int64()), ("kind", pa.int32()), ("a", pa.binary())])

        def run(batches):
            model, runs, known, heads = _read(batches, code)
            for number, facts in heads:
                yield pa.RecordBatch.from_pydict({"run": [number], "kind": [2], "a": [facts]}, schema=shape)
            if model is None:
                return
            own = code.of(model.w)
            count, p = np.zeros(len(own), np.int64), chances[own]
            rare = np.flatnonzero(own == 0)
            p[rare] = unseen
            if known and len(rare):
                w, c, q = (np.concatenate([k[i] for k in known]) for i in range(3))
                order = np.argsort(w)
                at = order[np.minimum(np.searchsorted(w[order], model.w[rare]), len(w) - 1)]
                hit = w[at] == model.w[rare]
                count[rare[hit]], p[rare[hit]] = c[at[hit]], q[at[hit]]
            total = 0.0
            for sweep in range(BURN_IN + SAMPLES):
                model.sweep(p, LEARN + sweep)
                if sweep >= BURN_IN:
                    total = total + model.predictive(p)[0]
            logs = np.log10(total / SAMPLES)
            base, seen = np.log10(count + 0.5) - base_scale, (count > 0).astype(np.float64)
            start, rows = 0, {k: [] for k in shape.names}
            for number, doc in runs:
                # Texts of a run lie in ascending order.
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                docs, to = doc[first], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(doc)]))
                dish = model.at[0][start : start + len(doc)]
                word = model.at[1][dish]
                start += len(doc)
                other = np.flatnonzero(own[word] == 0)
                some, of = np.unique(to[other], return_inverse=True)
                word = word[other]
                sums = (np.diff(docs, prepend=0).astype("<u2"), np.bincount(to, logs[dish]), docs[some].astype("<u2"), np.bincount(of, seen[word]).astype("<u4"), np.bincount(of, base[word]))
                for k, v in zip(shape.names, (number, 0, _squeezed(*sums)), strict=True):
                    rows[k].append(v)
                if len(rows["run"]) == 64:
                    yield pa.RecordBatch.from_pydict(rows, schema=shape)
                    rows = {k: [] for k in shape.names}
            if rows["run"]:
                yield pa.RecordBatch.from_pydict(rows, schema=shape)

        return run

    return map_arrow(dealt.repartitionById(buckets, "bucket"), make, "run long, kind int, a binary")


def _documents(sums: DataFrame, parts: int) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score``: the sums of each run's documents."""

    def make():
        from .jaccard_join import _groups

        def run(batches):
            for _, rows in _groups(batches):
                head = next(r for r in rows if r[1] == 2)
                ids, valid, n, known, base = _opened(head[2], "<i8", "u1", "<i8", "<i8", "<f8")
                score = np.zeros(len(ids))
                for _, kind, a in sorted(rows, key=lambda r: r[2]):
                    if kind == 0:
                        docs, logs, some, seen, own = _opened(a, "<i8", "<f8", "<i8", "<i8", "<f8")
                        score[np.cumsum(docs)] += logs
                        known[some] += seen
                        base[some] += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        return run

    return map_arrow(sums.repartition(parts, "run").sortWithinPartitions("run"), make, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def _hashed(vocabulary: DataFrame) -> DataFrame:
    """``w, word, raw``: words with the hash by which tokens are dealt."""

    def make():
        def run(batches):
            for batch in batches:
                h = py._hash_of(batch.column(0)) >> _BITS
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0), batch.column(1)], ["w", "word", "raw"])

        return run

    return map_arrow(vocabulary.select("word", "c"), make, "w long, word binary, raw long")


def score(docs: DataFrame, training: Column) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``.

    Rows where ``training`` is true are learned from. ``score`` is the model's log10
    probability of the text; the text's perplexity is ``10 ** (-score / n_tokens)``.
    """
    spark = docs.sparkSession
    flag = F.coalesce(training, F.lit(False))
    body = F.coalesce("text", F.lit("")).cast("binary")
    flagged = F.concat(F.when(flag, F.lit(b"1")).otherwise(F.lit(b"0")), body).alias("body")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    vocabulary = materialize(_hashed(py._count_words(docs.where(flag).select(doc_id, body.alias("body")))), "py-words", tidy=True)
    n_train = docs.where(flag).count()
    facts = vocabulary.agg(F.count("*").alias("v"), F.coalesce(F.sum("raw"), F.lit(0)).alias("n")).first()
    tokens, distinct = facts.n + n_train, facts.v + (n_train > 0)
    base_scale = math.log10(tokens + 0.5 * (distinct + 1))
    buckets = max(shuffle_partitions(spark), -(-tokens // BUCKET_TOKENS))
    often = vocabulary.where(F.col("raw") > SHARE_TOKENS).orderBy(F.desc("raw"), "w").limit(HOT).select("w", "raw").toPandas()
    shares = Shares(often.w.to_numpy(np.int64).view(_U), often.raw.to_numpy(np.int64), n_train)
    frequent = vocabulary.where(F.col("raw") * CODED >= tokens).orderBy(F.desc("raw"), "w").select("w", "raw").toPandas()
    h = frequent.w.to_numpy(np.int64).view(_U)
    code = Codes(h, shares, buckets)
    codes = spark.sparkContext.broadcast(code)  # CODED words at most
    end = code.of(np.array([_END]))
    counts, chances = np.zeros(len(code.words), np.int64), np.zeros(len(code.words))
    counts[code.of(h)], counts[end] = frequent.raw.to_numpy(np.int64), n_train
    scores = np.log10(counts + 0.5) - base_scale
    counts[0], scores[0] = 0, 0.0
    dealt = _deal(docs.select(doc_id, flagged), buckets, shares, codes, spark.sparkContext.broadcast((counts, scores)))
    if not n_train:
        unseen = 0.5 / 10**base_scale
        chances[:] = unseen
        sums = _score(dealt, buckets, base_scale, unseen, codes, spark.sparkContext.broadcast(chances))
    else:
        tables = materialize(_learn(_deal(docs.select(doc_id, flagged), buckets, shares, codes), buckets, facts.v, codes), "py-tables", tidy=True)
        customers = materialize(_customers(tables, codes, shuffle_partitions(spark)), "py-customers", tidy=True)
        forget(tables)
        last = customers.where(F.col("w") == int(_END)).first()
        words = materialize(vocabulary.join(customers, "w").select("w", "word", "raw", "c", "buckets"), "py-words", tidy=True)
        forget(vocabulary)
        forget(customers)
        root, end_p, unseen = py.word_model(words, last.c)
        of_codes = root.where("buckets IS NULL").select("w", "p").toPandas()
        chances[code.of(of_codes.w.to_numpy(np.int64).view(_U))], chances[end] = of_codes.p.to_numpy(np.float64), end_p
        answers = _answers(root.where("buckets IS NOT NULL"))
        sums = _score(dealt.unionByName(answers), buckets, base_scale, unseen, codes, spark.sparkContext.broadcast(chances))
    out = _documents(sums, shuffle_partitions(spark))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
