"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording is a WAV file (PCM, 16 bits, one channel) in a binary column. Frames
of its spectrum are folded to 12 pitch classes; sums over rectangles of that
image, read from an integral image, give 16 filter values a frame, each cut to 2
bits, packed to a 32-bit integer. Recordings align at the offset that most equal
integers agree on; they match when the share of differing bits there is at most
``MAX_ERROR`` over at least ``MIN_OVERLAP`` frames. Frames that are silent in both
are no agreement: they have no votes and count neither as frames nor as bits; one
silent frame differs from a heard one in all bits. A run of one integer votes with
its first and its last frame only. Every offset with a vote is verified.

Search: recordings with equal fingerprints form one class, which is searched
once; no pairs of copies are made. Every query class is compared with every other
class that shares an integer with it, at every offset that one votes for: no integer is
left out, however frequent, and no vote, so what is found is what ``align`` finds over
all pairs. Classes and queries are dealt as blocks of bounded size; a task holds one
block of each, looks the queries' integers up in the sorted integers of its classes,
and hands on one row for each query, so no row is made for a pair. The votes
themselves, and the matches that ``n_matches`` counts, grow with the square of the
table; only the work in the tasks does, not what a task holds.

Null, empty or broken media, and recordings shorter than one filter window, have
no integers, are in no class and match nothing. A silent recording has a class and
matches nothing.
Rows with the same id are recordings of their own in the same class or another.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, shuffle_partitions

FRAME, HOP = 1024, 256
#: Notes are looked for from the first to the last of these frequencies (Hz).
LOWEST, HIGHEST = 110.0, 1760.0
#: Frames that a filter covers at most.
WIDTH = 16
#: Places of one integer whose votes are worked out at a time.
COMMON = 1000
MAX_ERROR = 0.25
MIN_OVERLAP = 48
#: Frames of a block of classes or queries, and what a class adds to its own.
BLOCK, ROW = 1 << 20, 64
#: Cuts of a filter value.
CUTS = (-0.25, 0.0, 0.25)


def read_wav(data: bytes) -> tuple[int, np.ndarray] | None:
    """Sample rate and samples in -1..1, or None if it is not such a file."""
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, rate, kind = 12, 0, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt " and size >= 16:
            kind = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            rate = kind[2]
        elif name == b"data":
            if not kind or kind[:2] != (1, 1) or kind[5] != 16 or not rate:
                return None
            body = data[at + 8 : at + 8 + size]
            return rate, np.frombuffer(body[: len(body) // 2 * 2], "<i2") / 32768.0
        at += 8 + size + size % 2
    return None


def write_wav(rate: int, samples: np.ndarray) -> bytes:
    body = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def chroma_frames(rate: int, samples: np.ndarray) -> np.ndarray:
    """``(frames, 12)`` energy of each pitch class, every frame of sum 1 (silence: all equal)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    bins = np.fft.rfftfreq(FRAME, 1 / rate)
    used = (bins >= LOWEST) & (bins <= HIGHEST)
    pitch = np.mod(np.round(12 * np.log2(np.maximum(bins, 1) / 440.0)).astype(int), 12)
    fold = np.zeros((len(bins), 12))
    fold[np.flatnonzero(used), pitch[used]] = 1
    window = np.hanning(FRAME)
    out = []
    for at in range(0, n, 4096):  # so that very long recordings stay small
        part = samples[at * HOP : (min(n, at + 4096) - 1) * HOP + FRAME]
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * window
        out.append((np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ fold)
    energy = np.concatenate(out)
    total = energy.sum(axis=1, keepdims=True)
    return np.where(total > 1e-6, energy / np.maximum(total, 1e-12), 1 / 12)


def _filters() -> list[tuple[int, int, int, int]]:
    """16 filters by rule: kind, first pitch class, height, width."""
    return [(k % 4, (5 * k) % 9, 4 if k % 3 else 3, (4, 8, 12, 16)[k // 4]) for k in range(16)]


def integers(chroma: np.ndarray) -> np.ndarray:
    """One packed integer for each frame that has a whole filter window."""
    n = len(chroma) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(x0, x1, y0, y1):
        return image[t + x1, y1] - image[t + x0, y1] - image[t + x1, y0] + image[t + x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, height, width in _filters():
        h, w = height // 2, width // 2
        whole = area(0, width, y, y + height)
        if kind == 0:  # this band against the rest
            a, b = whole * (12 - height), (width - whole) * height
        elif kind == 1:  # lower against upper pitch classes
            a = area(0, width, y, y + h) * (height - h)
            b = area(0, width, y + h, y + height) * h
        elif kind == 2:  # earlier against later
            a = area(0, w, y, y + height)
            b = whole - a
        else:  # opposite quarters
            a = area(0, w, y, y + h) + area(w, width, y + h, y + height)
            b = whole - a
        value = np.round(np.log((0.05 + a) / (0.05 + b)), 6)  # equal areas of an integral image differ in the last bits
        level = np.searchsorted(CUTS, value).astype(np.uint32)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))  # neighbours differ in one bit
    return out


#: The integer of silence.
SILENT = int(integers(np.full((WIDTH, 12), 1 / 12))[0])
#: Pairs of equal runs that are counted, or frames that are compared, at a time.
VOTES = 1 << 18


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last frame of each run of one integer, silence left out."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turns = np.flatnonzero(codes[1:] != codes[:-1])
    first, last = np.concatenate([[0], turns + 1]), np.concatenate([turns, [len(codes) - 1]])
    heard = codes[first] != SILENT
    return first[heard], last[heard]


def _votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The offset histogram: votes for offset ``i - len(a)`` at ``i``."""
    votes = np.zeros(len(a) + len(b) + 1, np.int64)
    for at_a, at_b in zip(_runs(a), _runs(b), strict=True):
        at_b = at_b[np.argsort(b[at_b], kind="stable")]
        low, high = (np.searchsorted(b[at_b], a[at_a], side) for side in ("left", "right"))
        same = high - low
        part = np.cumsum(same) // VOTES
        for p in np.unique(part[same > 0]):
            n, start, i = (x[part == p] for x in (same, low, at_a))
            j = at_b[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
            votes += np.bincount(j - np.repeat(i, n) + len(a), minlength=len(votes))
    return votes


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float, int] | None:
    """Offset of ``a`` in ``b``, share of differing bits, frames compared; None without ``MIN_OVERLAP`` of them.

    Of all offsets with votes, that of least error, then nearest 0, then least.
    """
    best = None
    for offset in (np.flatnonzero(_votes(a, b)) - len(a)).tolist():
        s, e = max(0, -offset), min(len(a), len(b) - offset)
        if e - s < MIN_OVERLAP:
            continue
        x, y = a[s:e], b[s + offset : e + offset]
        still = (x == SILENT).astype(np.int8) + (y == SILENT)
        n = e - s - int((still == 2).sum())
        if n >= MIN_OVERLAP:
            error = float(np.where(still == 1, 32, np.bitwise_count(x ^ y)).sum()) / (32 * n)
            best = min(best or (error, abs(offset), offset, n), (error, abs(offset), offset, n))
    return best and (best[2], best[0], best[3])


def fingerprint(recordings: DataFrame) -> DataFrame:
    """``rec_id, n_frames, codes (binary, little-endian 32 bits), cls`` of ``rec_id, media``; ``cls`` is null without codes."""

    def make():
        def run(batches):
            for batch in batches:
                codes = []
                for media in batch.column(1):
                    wav = read_wav(media.as_py() or b"")
                    codes.append(integers(chroma_frames(*wav)).astype("<u4").tobytes() if wav else b"")
                cls = [hashlib.sha256(c).hexdigest() if c else None for c in codes]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array(codes, pa.binary()), pa.array(cls, pa.string())], ["rec_id", "n_frames", "codes", "cls"])

        return run

    return map_arrow(recordings.selectExpr("cast(rec_id as long) rec_id", "media"), make, "rec_id long, n_frames long, codes binary, cls string")


class Joined:
    """Fingerprints one after the other: where each begins, its length, and whose each frame is."""

    def __init__(self, codes: list[np.ndarray]):
        self.codes = np.concatenate([np.zeros(0, np.uint32), *codes])
        self.size = np.fromiter(map(len, codes), np.int64, len(codes))
        self.start = np.cumsum(self.size) - self.size
        self.own = np.repeat(np.arange(len(codes)), self.size)
        runs = [_runs(c) for c in codes]
        #: First and last frames of runs.
        self.runs = [np.concatenate([np.zeros(0, np.int64), *(r[k] + s for r, s in zip(runs, self.start.tolist(), strict=True))]) for k in (0, 1)]


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each ``start`` on."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _parts(n: np.ndarray) -> list[slice]:
    """Neighbours whose numbers add up to about ``VOTES``."""
    part = (np.cumsum(n) - n) // VOTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(n)]
    return [slice(s, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True) if s < e]


def _errors(a: Joined, b: Joined, q: np.ndarray, c: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of differing bits of ``q`` in ``c`` at ``offset``, and frames compared (as ``align`` counts them)."""
    begin = np.maximum(0, -offset)
    n = np.minimum(a.size[q], b.size[c] - offset) - begin
    error, frames = np.ones(len(q)), np.zeros(len(q), np.int64)
    for part in _parts(n):
        size = n[part]
        i = _spread((a.start[q] + begin)[part], size)
        j = i + np.repeat((b.start[c] + offset - a.start[q])[part], size)
        x, y = a.codes[i], b.codes[j]
        still = (x == SILENT).astype(np.int8) + (y == SILENT)
        first = np.cumsum(size) - size
        frames[part] = size - np.add.reduceat(still == 2, first, dtype=np.int64)
        bits = np.add.reduceat(np.where(still == 1, 32, np.bitwise_count(x ^ y)), first, dtype=np.int64)
        error[part] = bits.astype(np.float64) / (32 * np.maximum(frames[part], 1))
    return error, frames


def matches(queries: list[np.ndarray], classes: list[np.ndarray]):
    """``q, c, offset, error`` of the pairs that match, in any order; those of some whole queries at a time.

    The same as ``align`` of all pairs, with all votes of the queries looked up at once.
    """
    a, b = Joined(queries), Joined(classes)
    frame, low, n, places, before = [], [], [], [], 0
    for at_a, at_b in zip(a.runs, b.runs, strict=True):
        at_b = at_b[np.argsort(b.codes[at_b], kind="stable")]
        left, right = (np.searchsorted(b.codes[at_b], a.codes[at_a], side) for side in ("left", "right"))
        times = -(-(right - left) // COMMON)
        k = _spread(np.zeros(len(times), np.int64), times) * COMMON
        frame.append(np.repeat(at_a, times))
        low.append(np.repeat(left, times) + k + before)
        n.append(np.minimum(np.repeat(right - left, times) - k, COMMON))
        places.append(at_b)
        before += len(at_b)
    frame, low, n, places = (np.concatenate(x) for x in (frame, low, n, places))
    order = np.argsort(a.own[frame], kind="stable")
    frame, low, n = frame[order], low[order], n[order]
    first = np.searchsorted(a.own[frame], np.arange(len(queries) + 1))
    votes = np.diff(np.r_[0, np.cumsum(n)][first])
    left_out, span = int(a.size.max(initial=0)), int(a.size.max(initial=0) + b.size.max(initial=0)) + 1
    for some in _parts(votes):
        own = slice(first[some.start], first[some.stop])
        found = [np.zeros((4, 0))]
        for part in _parts(n[own]):
            size = n[own][part]
            i, j = np.repeat(frame[own][part], size), places[_spread(low[own][part], size)]
            q, c = a.own[i], b.own[j]
            offset = (j - b.start[c]) - (i - a.start[q])
            long = np.minimum(a.size[q], b.size[c] - offset) - np.maximum(0, -offset) >= MIN_OVERLAP
            key = np.unique((q[long] * len(classes) + c[long]) * span + offset[long] + left_out)
            pair, offset = key // span, key % span - left_out
            error, frames = _errors(a, b, pair // len(classes), pair % len(classes), offset)
            good = (frames >= MIN_OVERLAP) & (error <= MAX_ERROR)
            found.append(_least(np.stack([pair[good], error[good], abs(offset[good]), offset[good]])))
        pair, error, _, offset = _least(np.concatenate(found, axis=1))
        pair = pair.astype(np.int64)
        yield pair // len(classes), pair % len(classes), offset.astype(np.int64), error


def _least(rows: np.ndarray) -> np.ndarray:
    """Of columns with the same first number, the least."""
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.r_[True, rows[0, 1:] != rows[0, :-1]][: rows.shape[1]]]


def _searched(classes: DataFrame) -> DataFrame:
    """``cls, n_matches, best (error, class_id, offset)`` of the query classes that match another."""
    weight = F.octet_length("codes") / 4 + ROW
    facts = classes.agg(F.sum(weight).alias("all"), F.sum(F.when(F.col("is_query"), weight)).alias("asked")).first()
    # As many blocks as the size needs, and more (an eighth of the size) for the tasks that run at a time.
    count = lambda total, tasks: max(1, math.ceil((total or 0) / BLOCK), min(tasks, math.ceil(8 * (total or 0) / BLOCK)))
    n_all, n_asked = count(facts["all"], shuffle_partitions(classes.sparkSession)), count(facts["asked"], 1)
    block = lambda n: F.pmod(F.xxhash64("cls"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = classes.select("cls", "class_id", "codes", F.lit(False).alias("asked"), block(n_all).alias("block"), every(n_asked).alias("other")).withColumn("block", F.col("other") * n_all + F.col("block"))
    asked = classes.where("is_query").select("cls", "class_id", "codes", F.lit(True).alias("asked"), block(n_asked).alias("block"), every(n_all).alias("other")).withColumn("block", F.col("block") * n_all + F.col("other"))
    dealt = held.unionByName(asked).repartitionById(n_all * n_asked, "block")

    def make():
        shape = pa.schema([("cls", pa.string()), ("n", pa.int64()), ("error", pa.float64()), ("class_id", pa.int64()), ("offset", pa.int64())])

        def run(batches):
            names, ids, codes = ([], []), [], ([], [])
            for batch in batches:  # one block of classes and one of queries
                for cls, class_id, data, asks in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    names[asks].append(cls)
                    codes[asks].append(np.frombuffer(data, "<u4"))
                    if not asks:
                        ids.append(class_id)
            at = {cls: k for k, cls in enumerate(names[0])}
            same = np.array([at.get(cls, -1) for cls in names[1]], np.int64)
            known, number = np.array([i is not None for i in ids], bool), np.array([i or 0 for i in ids], np.int64)
            for q, c, offset, error in matches(codes[1], codes[0]):
                q, c, offset, error = (x[c != same[q]] for x in (q, c, offset, error))
                order = np.lexsort((offset, number[c], known[c], error, q))
                q, first, n = np.unique(q[order], return_index=True, return_counts=True)
                c, offset, error = (x[order[first]] for x in (c, offset, error))
                yield pa.RecordBatch.from_arrays([pa.array([names[1][k] for k in q.tolist()], pa.string()), pa.array(n.astype(np.int64)), pa.array(error), pa.array(number[c], mask=~known[c]), pa.array(offset)], schema=shape)

        return run

    found = map_arrow(dealt.select("cls", "class_id", "codes", "asked"), make, "cls string, n long, error double, class_id long, offset long")
    return found.groupBy("cls").agg(F.sum("n").alias("n_matches"), F.min(F.struct("error", "class_id", "offset")).alias("best"))


def match(recordings: DataFrame, every: int = 20) -> DataFrame:
    """One row for each recording, with what a search for it found.

    ``rec_id, n_frames, class_id`` (least id with the same fingerprint; its own
    without one), ``class_size``, ``is_query`` (id divisible by ``every``), and for
    queries ``n_matches`` (other classes that match), ``best_id`` (class of least
    error, then least id), ``best_offset``, ``best_error``.
    """
    prints = materialize(fingerprint(recordings), "chroma-prints")
    classes = prints.where("cls IS NOT NULL").groupBy("cls").agg(F.min("rec_id").alias("class_id"), F.count("*").alias("class_size"), F.first("codes").alias("codes"), F.max(F.coalesce(F.col("rec_id") % every == 0, F.lit(False))).alias("is_query"))
    classes = materialize(classes, "chroma-classes")
    best = _searched(classes)
    facts = classes.select("cls", "class_id", "class_size").join(best, "cls", "left")
    is_query = F.coalesce(F.col("rec_id") % every == 0, F.lit(False))
    known = prints.where("cls IS NOT NULL").select("rec_id", "n_frames", "cls").join(facts, "cls")
    known = known.select(
        "rec_id", "n_frames", "class_id", "class_size", is_query.alias("is_query"), F.when(is_query, F.coalesce("n_matches", F.lit(0))).alias("n_matches"),
        F.when(is_query, F.col("best.class_id")).alias("best_id"), F.when(is_query, F.col("best.offset")).alias("best_offset"), F.when(is_query, F.col("best.error")).alias("best_error"),
    )
    none = prints.where("cls IS NULL").select(
        "rec_id", "n_frames", F.col("rec_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), is_query.alias("is_query"), F.when(is_query, F.lit(0).cast("long")).alias("n_matches"),
        F.lit(None).cast("long").alias("best_id"), F.lit(None).cast("long").alias("best_offset"), F.lit(None).cast("double").alias("best_error"),
    )
    return known.unionByName(none)


#: Rate of the rendered recordings, samples of a note.
RATE, NOTE = 4000, 512


def render(vector: list[float] | None) -> bytes | None:
    """A recording of a vector: one note for each value, its pitch class by the value."""
    if not vector:
        return None
    v = np.nan_to_num(np.array([x or 0.0 for x in vector], np.float64), posinf=0, neginf=0)
    pitch = np.mod(np.round(v * 24).astype(int) + 5 * np.arange(len(v)), 12)
    t = np.arange(NOTE) / RATE
    tones = 0.4 * np.sin(2 * np.pi * (440.0 * 2.0 ** ((np.arange(12) - 9) / 12))[:, None] * t) * np.hanning(NOTE) ** 0.25
    return write_wav(RATE, tones[pitch].ravel())


def recordings(vectors: DataFrame) -> DataFrame:
    """``rec_id, media``: the tables hold no audio, so their vectors are rendered as recordings."""

    def make():
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(v.as_py()) for v in part.column(1)], pa.binary())], ["rec_id", "media"])

        return run

    return map_arrow(vectors.selectExpr("cast(vec_id as long) rec_id", "cast(embedding as array<double>) embedding"), make, "rec_id long, media binary")
