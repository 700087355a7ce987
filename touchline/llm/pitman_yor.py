"""The word restaurant of the Pitman-Yor model, and its spelling.

The customers of the word restaurant are the tables that the restaurants of contexts
send (``context_model``). Its base measure spells words: a hierarchy of restaurants
over the bytes of a word, whose context restaurants (two classes of preceding bytes)
share parents (one class, none) and end in the uniform distribution. Each table of the
word restaurant sends its word to the spelling restaurants, each table there a customer
to its parent.

Table counts are sampled by Gibbs: all customers of a dish leave and sit down again
given the others (``seating.draw_tables``). Dishes move at once, with totals as they
were before the sweep. Random numbers follow from the word's hash and the sweep, so
results do not depend on how the rows lie. Predictive probabilities are averaged over
samples.

Outcomes are the ``V`` distinct training tokens and one outcome for any unseen
word, as in the base score: an unseen word has the mass of a new table times what
the spelling model leaves to unseen words. Probabilities of all outcomes add up
to 1. What is collected is the spelling cells, at most ``CONTEXTS * SYMBOLS``, whatever
the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, in_text_chunks, joined, map_arrow, materialize
from .seating import draw_tables
from .textvec import Words, mix, range_hashes

#: Spelled symbols: bytes and the end of a word.
SYMBOLS = 257
#: Classes of preceding bytes: a-z, digits, others below 128, 4 of bytes from 128, start.
CLASSES = 33
CONTEXTS = CLASSES * CLASSES
STRENGTH = 1.0
BURN_IN, SAMPLES = 3, 3
#: Sweeps over the words, each with the tables and the spelling of the one before.
ROUNDS = 2
#: Mass of the end token in the base measure.
END_BASE = 0.01
RUN_BYTES = 4_000_000
#: Words that are seated at a time.
WORDS = 50_000
_HELD = 400_000

_CLASS = np.array([b - 97 if 97 <= b < 123 else 26 if 48 <= b < 58 else 27 if b < 128 else 28 + b % 4 for b in range(256)], np.int64)
_START = 32


def discount_of(n: np.ndarray) -> float:
    """The discount by the numbers of dishes with one and with two customers."""
    one, two = int((n == 1).sum()), int((n == 2).sum())
    return min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.5


def spelling_model(counts: np.ndarray) -> np.ndarray:
    """Averaged predictive probabilities ``(CONTEXTS, SYMBOLS)`` from customers of that shape."""
    # Restaurants of a level share one array of dishes (restaurant * SYMBOLS + symbol).
    parent = [np.arange(CONTEXTS) % CLASSES, np.zeros(CLASSES, np.int64), None]
    places = [CONTEXTS, CLASSES, 1]
    n = [counts.reshape(CONTEXTS, SYMBOLS).astype(np.int64)]
    t = [np.minimum(n[0], 1)]

    def to_parent(level: int) -> np.ndarray:
        out = np.zeros((places[level + 1], SYMBOLS), np.int64)
        np.add.at(out, slice(None) if parent[level] is None else parent[level], t[level])
        return out

    for level in range(2):
        n.append(to_parent(level))
        t.append(np.minimum(n[-1], 1))
    d = [discount_of(x) for x in n]
    uniform = np.full((1, SYMBOLS), 1 / SYMBOLS)

    def up_of(level: int, probabilities: np.ndarray) -> np.ndarray:
        return probabilities if parent[level] is None else probabilities[parent[level]]

    def predictive() -> list[np.ndarray]:
        out = [uniform]
        for level in (2, 1, 0):
            tables, customers = t[level].sum(axis=1, keepdims=True), n[level].sum(axis=1, keepdims=True)
            out.insert(0, (n[level] - d[level] * t[level] + (STRENGTH + d[level] * tables) * up_of(level, out[0])) / (STRENGTH + customers))
        return out

    total = np.zeros((CONTEXTS, SYMBOLS))
    for sweep in range(BURN_IN + SAMPLES):
        p = predictive()
        for level in range(3):
            if level:
                n[level] = to_parent(level - 1)
                t[level] = np.minimum(t[level], n[level])
            others = STRENGTH + d[level] * (t[level].sum(axis=1, keepdims=True) - t[level])
            up = np.broadcast_to(up_of(level, p[level + 1]), n[level].shape)
            key = mix(np.arange(n[level].size, dtype=np.uint64) + np.uint64(level << 40))
            t[level] = draw_tables(n[level].ravel(), others.ravel(), up.ravel(), d[level], key, sweep).reshape(n[level].shape)
        if sweep >= BURN_IN:
            total += predictive()[0]
    return total / SAMPLES


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each spelled symbol of the words: context, symbol, and the word's index."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"\n".join([*words, b""]), np.uint8)  # a line feed stands for the end
    word = np.repeat(np.arange(len(words)), length + 1)
    first = np.cumsum(length + 1) - length - 1
    place = np.arange(len(raw)) - first[word]
    end = place == length[word]
    kind = _CLASS[raw]
    one = np.where(place >= 1, np.r_[_START, kind[:-1]], _START)
    two = np.where(place >= 2, np.r_[_START, _START, kind[:-2]][: len(raw)], _START)
    return two * CLASSES + one, np.where(end, 256, raw).astype(np.int64), word


def _count_words(rows: DataFrame) -> DataFrame:
    """``word, c`` over the texts of ``(doc_id, body)``; every task combines its own first."""

    def make():
        def run(batches):
            held: dict[bytes, int] = {}

            def flush():
                words, counts = list(held), list(held.values())
                held.clear()
                for i in range(0, len(words), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array(counts[i : i + 50_000], pa.int64())], ["word", "c"])

            for _, texts in in_text_chunks(batches, RUN_BYTES):
                words, _, at, _ = distinct(Words(texts))
                for word, n in zip(words, np.bincount(at, minlength=len(words)).tolist(), strict=True):
                    held[word] = held.get(word, 0) + n
                if len(held) > _HELD:
                    yield from flush()
            yield from flush()

        return run

    return map_arrow(rows, make, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def distinct(words: Words) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, their hashes, the distinct word of each word, and starts."""
    all_h = words.hashes()
    order = np.argsort(all_h)  # not stable as in np.unique, which is faster
    new = np.ones(len(order), bool)
    np.not_equal(all_h[order[1:]], all_h[order[:-1]], out=new[1:])
    start = np.flatnonzero(new)
    h, first = all_h[order[start]], np.minimum.reduceat(order, start) if len(order) else order
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    buf = words.buf.tobytes()
    return [buf[s:e] for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)], h, at, first


def _spelling_cells(vocabulary: DataFrame) -> np.ndarray:
    """Customers of the spelling restaurants: ``tables`` of each word."""

    def make():
        def run(batches):
            total = np.zeros(CONTEXTS * SYMBOLS, np.int64)
            for batch in batches:
                context, symbol, word = spelled(batch.column(0).to_pylist())
                total += np.bincount(context * SYMBOLS + symbol, np.asarray(batch.column(1))[word], len(total)).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

        return run

    cells = map_arrow(vocabulary.select("word", "tables"), make, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CONTEXTS * SYMBOLS, np.int64)
    out[cells.cell.to_numpy()] = cells.n.to_numpy()
    return out.reshape(CONTEXTS, SYMBOLS)


def _hash_of(word: pa.Array) -> np.ndarray:
    """Hashes of words, as ``Words.hashes`` gives them."""
    length = np.asarray(pc.binary_length(word)).astype(np.int64)
    end = np.cumsum(length + 1) - 1
    return range_hashes(np.frombuffer(b"\n".join([*word.to_pylist(), b""]), np.uint8), end - length, end)


def _word_seats(words: DataFrame, spelling: np.ndarray, discount: float, tables: int, sweep: int, samples: int) -> DataFrame:
    """``words`` with ``p0`` and ``seats``: its tables (``tables`` in all before) in ``samples`` samples."""
    shared = words.sparkSession.sparkContext.broadcast(spelling)  # CONTEXTS * SYMBOLS
    word_at, c_at, tables_at = (words.columns.index(k) for k in ("word", "c", "tables"))

    def make():
        log_p = np.log(shared.value)

        def run(batches):
            for batch in joined(batches, WORDS):
                context, symbol, word = spelled(batch.column(word_at).to_pylist())
                p0 = (1 - END_BASE) * np.exp(np.bincount(word, log_p[context, symbol], batch.num_rows))
                others = STRENGTH + discount * (tables - np.asarray(batch.column(tables_at)))
                c, key = np.asarray(batch.column(c_at)), _hash_of(batch.column(word_at))
                kept = np.stack([draw_tables(c, others, p0, discount, key, sweep + k) for k in range(samples)], axis=1)
                seats_of = pa.FixedSizeListArray.from_arrays(pa.array(kept.ravel()), samples).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p0), seats_of], [*batch.schema.names, "p0", "seats"])

        return run

    schema = T.StructType([*words.schema.fields, T.StructField("p0", T.DoubleType()), T.StructField("seats", T.ArrayType(T.LongType()))])
    return map_arrow(words, make, schema)


def word_model(words: DataFrame, end_customers: int) -> tuple[DataFrame, float, float]:
    """``words (word, c, ..)`` with ``p``, for ``c`` customers, and the probabilities of the end and of an unseen word.

    ``ROUNDS`` sweeps; each one's tables are the customers of the next one's spelling.
    """
    facts = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).first()
    discount = min(0.9, max(0.1, facts.one / (facts.one + 2 * facts.two))) if facts.one else 0.5
    now, tables, old = words.withColumn("tables", F.lit(1).cast("long")), facts.v, words
    for k in range(ROUNDS):
        samples = SAMPLES if k == ROUNDS - 1 else 1
        seats = _word_seats(now, spelling_model(_spelling_cells(now)), discount, tables, k, samples)
        if samples == 1:
            seats = seats.drop("p0", "tables").withColumn("tables", F.col("seats")[0]).drop("seats")
        now = materialize(seats, "py-seats", tidy=True)
        forget(old)
        old = now
        if samples == 1:
            tables = now.agg(F.coalesce(F.sum("tables"), F.lit(0)).alias("t")).first().t
    totals = now.agg(*(F.coalesce(F.sum(F.col("seats")[k]), F.lit(0)).alias(f"t{k}") for k in range(SAMPLES)), F.coalesce(F.sum("p0"), F.lit(0.0)).alias("p0")).first()
    # The end token sits at one table of its own in every sample.
    whole = STRENGTH + facts.n + end_customers
    new = [(STRENGTH + discount * (totals[f"t{k}"] + (end_customers > 0))) / whole for k in range(SAMPLES)]
    mean = sum(new) / SAMPLES
    p_word = sum(((F.col("c") - discount * F.col("seats")[k]) / whole + F.lit(new[k]) * F.col("p0") for k in range(SAMPLES)), F.lit(0.0)) / SAMPLES
    end_p = (end_customers - discount) / whole + mean * END_BASE
    return now.withColumn("p", p_word).drop("p0", "seats", "tables"), end_p, mean * max(1e-9, 1 - END_BASE - totals.p0)
