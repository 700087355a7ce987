"""Vector code compression: product codes from integer codebooks fitted by rounds.

Vectors become integers ``floor(scale * x)`` and are cut into equal consecutive
parts; each part has a codebook of integer entries. A round broadcasts the
codebooks, every Arrow batch computes all distances by norm expansion
(``|x|^2 - 2 x.c + |c|^2`` with exact int64 products) and takes the first least
one; each task sums its parts by entry, and a grouped shuffle merges one row for
each task and entry. No vector is ever shuffled, so neither equal vectors nor
equal labels make a hot task.

Broadcast and collected: the codebooks only, ``ENTRIES`` integers for each
component of a vector.

Results in odd cases. Rows whose vector is null or holds a null or non-finite
component are left out. The length is that of the kept vector of smallest id.
Vectors of another length, all if the parts cannot be equal, and those with a
component too large for exact distances (beyond ``largest``) have a null code and
error and teach nothing. Codebooks start from the smallest ids, nulls last, ties
by vector; with fewer rows than entries there are fewer entries.
Repeated rows count as often as they occur. Null labels are one label; where all
errors of a label are null, so is their sum. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, maybe_broadcast

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors whose distances are held at once.
BLOCK = 512


def kept(vectors: DataFrame, vec: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vec).isNotNull() & F.coalesce(F.forall(F.col(vec), finite), F.lit(False))


def quantized(vec: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, as longs."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def largest(width: int) -> int:
    """Largest integer component of vectors of ``width`` whose squared distances surely fit a long."""
    return math.isqrt((1 << 60) // max(1, width))


def _exact(ints: Column, width: int) -> Column:
    """``ints`` where it has ``width`` components that ``largest`` allows, else null."""
    return F.when((F.size(ints) == width) & F.forall(ints, lambda v: v.between(-largest(width), largest(width))), ints)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are not null as a matrix, and which rows those are."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(rows), width), rows


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(code, distance)`` of ``parts[row, part, k]`` against ``books[part, entry, k]``; ties go to the lower entry."""
    codes = np.empty(parts.shape[:2], np.int64)
    least = np.empty(parts.shape[:2], np.int64)
    own = (books * books).sum(2)
    for at in range(0, len(parts), BLOCK):
        for p in range(parts.shape[1]):
            x = parts[at : at + BLOCK, p]
            d = (x * x).sum(1)[:, None] - 2 * (x @ books[p].T) + own[p]
            best = d.argmin(1)
            codes[at : at + BLOCK, p] = best
            least[at : at + BLOCK, p] = d[np.arange(len(x)), best]
    return codes, least


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, n, sums`` of the parts assigned to each entry."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    parts, entries, size = books.shape

    def make():
        books = shared.value

        def run(batches):
            count = np.zeros((parts, entries), np.int64)
            total = np.zeros((parts, entries, size), np.int64)
            for batch in batches:
                x, _ = _matrix(batch.column(0), parts * size)
                if not len(x):
                    continue
                x = x.reshape(len(x), parts, size)
                codes, _ = nearest(x, books)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(total[p], codes[:, p], x[:, p])
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": count[part, entry], "sums": pa.array(list(total[part, entry]), pa.list_(pa.int64()))},
            )

        return run

    each = map_arrow(vectors.select("ints"), make, "part int, entry int, n long, sums array<long>")
    merged = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size)))
    return merged.select("part", "entry", "n", F.array(*(F.col(f"s{k}") for k in range(size))).cast("array<long>").alias("sums"))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``[part, entry, k]`` of ``vec_id, ints``."""
    first = vectors.where("ints IS NOT NULL").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    rows = [r.ints for r in first]
    width = len(rows[0]) if rows else 0
    if width % parts or not rows:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array(rows, np.int64).reshape(len(rows), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(vectors, books).collect():  # at most one row for each entry
            books[r.part, r.entry] = [s // r.n for s in r.sums]
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of ``vec_id, label, ints``; ``code`` is the hex of one byte for each part."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    label = vectors.schema["label"].dataType.simpleString()

    def make():
        books = shared.value
        parts, entries, size = books.shape

        def run(batches):
            for batch in batches:
                n = batch.num_rows
                code, error = np.full(n, None, object), np.zeros(n, np.int64)
                x, rows = _matrix(batch.column(2), parts * size) if entries else (np.empty((0, 0)), np.empty(0, np.int64))
                if len(rows):
                    codes, least = nearest(x.reshape(len(rows), parts, size), books)
                    code[rows] = [c.tobytes().hex() for c in codes.astype(np.uint8)]
                    error[rows] = least.sum(1)
                blank = np.ones(n, bool)
                blank[rows] = False
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, mask=blank)], ["vec_id", "label", "code", "error"])

        return run

    return map_arrow(vectors.select("vec_id", "label", "ints"), make, f"vec_id long, label {label}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector``: the entries that the code names, divided by ``scale``."""
    table = F.lit([[[v / scale for v in entry] for entry in part] for part in books.tolist()]) if books.size else F.lit(None).cast("array<array<array<double>>>")
    spans = F.sequence(F.lit(0), F.lit(len(books) - 1))
    entry = lambda p: F.conv(F.substring("code", (2 * p + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("vector", F.when(F.col("code").isNotNull(), F.flatten(F.transform(spans, lambda p: table[p][entry(p)]))))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error, label_error`` of ``vec_id, embedding, label``, and the codebooks.

    ``label_error`` is the error summed over the rows of the label.
    """
    if entries > 256:
        raise ValueError("a code has one byte for each part")
    ints = vectors.where(kept(vectors)).select(F.col("vec_id").cast("long").alias("vec_id"), "label", quantized(F.col("embedding"), scale).alias("ints"))
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select(F.size("ints").alias("n")).first()
    ints = ints.withColumn("ints", _exact(F.col("ints"), first.n if first else 0))
    books = fit(ints, parts, entries, rounds)
    coded = materialize(encode(ints, books), "vector-codes")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-labels").withColumnRenamed("label", "_label")
    sums = maybe_broadcast(sums, sums.count(), 64)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books
