"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut into pieces by the public pattern. Pieces of a similar length make
the rows of one padded matrix of token ids. In each round every row merges its
leftmost pair of minimum rank: pairs are looked up in one hash table, the merged
cell takes the new id, and the row is compacted by one cell. Rows without a
mergeable pair leave. The result is what ``tiktoken`` gives for ordinary text.

Pieces recur, so each task keeps a bounded table of pieces already encoded and
only new ones enter the matrices. Pieces of more than ``LONG`` bytes, where one
merge a round would cost the square of the length, take the same merges in the
same order from a heap.

A null text counts as empty: no ids, empty bytes. Very long texts are encoded
whole. Extra columns are ignored, repeated rows each give their row, and an
empty table an empty result.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_bytes, in_text_chunks, map_arrow

#: Bytes of a piece beyond which the heap form is used.
LONG = 512
#: Pieces that a task remembers.
REMEMBERED = 250_000
_NONE = np.int32(np.iinfo(np.int32).max)
#: Cells of one matrix.
_CELLS = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class PairTable:
    """Open-addressing table from a pair of ids to the merged id, read in bulk."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (len(pairs) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        left = np.fromiter((a for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((b for _, b in pairs), np.int64, len(pairs))
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        key, todo, probe = left << 32 | right, np.arange(len(pairs)), 0
        slot = self._slot(key)
        while len(todo):  # every key still without a slot tries the next one
            at = (slot[todo] + probe) & self.mask
            free = self.keys[at] == -1
            self.keys[at[free]] = key[todo[free]]
            placed = self.keys[at] == key[todo]
            self.values[at[placed]] = value[todo[placed]]
            todo, probe = todo[~placed], probe + 1
        self.probes = probe

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, or the largest int32."""
        key = left.astype(np.int64) << 32 | right
        shape, key = key.shape, key.ravel()
        slot = self._slot(key)
        out = np.full(len(key), _NONE, np.int32)
        todo = np.arange(len(key))
        for probe in range(self.probes):
            at = (slot[todo] + probe) & self.mask
            seen = self.keys[at]
            hit = seen == key[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (seen != -1)]
            if not len(todo):
                break
        return out.reshape(shape)


class Codec:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Every way to cut a token into two tokens is a pair that merges to it.
        self.pairs = {
            (ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }
        self.table = PairTable(self.pairs)
        self.known: dict[str, bytes] = {}

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian 32 bits) of pieces of at most ``width`` bytes."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        cells = np.full((n, width + 1), -1, np.int32)
        inside = np.arange(width + 1) < length[:, None]
        cells[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, width), _NONE, np.int32)
        both = inside[:, 1:]
        rank[both] = self.table.look(cells[:, :-1][both], cells[:, 1:][both])
        rows = np.arange(n)
        while len(rows):
            live = rank[rows]
            at = live.argmin(axis=1)  # the first of equal minima is the leftmost
            best = live[np.arange(len(rows)), at]
            going = best != _NONE
            rows, at, best = rows[going], at[going], best[going]
            if not len(rows):
                break
            # Compaction: cells behind the merged one move left by one.
            column = np.arange(width + 1)
            source = np.minimum(column + (column > at[:, None]), width)
            moved = np.take_along_axis(cells[rows], source, axis=1)
            moved[:, -1] = -1
            moved[np.arange(len(rows)), at] = best
            ranks = np.take_along_axis(rank[rows], np.minimum(source[:, :width], width - 1), axis=1)
            ranks[:, -1] = _NONE
            length[rows] -= 1
            for side in (at - 1, at):  # the two pairs that the new cell is part of
                ok = (side >= 0) & (side + 1 < length[rows])
                r = np.flatnonzero(ok)
                ranks[r, side[r]] = self.table.look(moved[r, side[r]], moved[r, side[r] + 1])
                r = np.flatnonzero(~ok & (side >= 0) & (side < width))
                ranks[r, side[r]] = _NONE
            cells[rows], rank[rows] = moved, ranks
        return [cells[i, : length[i]].astype("<u4").tobytes() for i in range(n)]

    def _heap(self, piece: bytes) -> bytes:
        """The same merges for one long piece: lowest rank first, then leftmost."""
        n = len(piece)
        cell = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get((cell[i], cell[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if cell[i] < 0 or j >= n or pairs.get((cell[i], cell[j])) != r:
                continue
            cell[i], cell[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := pairs.get((r, cell[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (p := before[i]) >= 0 and (s := pairs.get((cell[p], r))) is not None:
                heapq.heappush(heap, (s, p))
        return np.array([c for c in cell if c >= 0], "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known yet, those of similar lengths together."""
        raw = sorted(((p, p.encode()) for p in pieces), key=lambda x: len(x[1]))
        left = []
        for piece, data in raw:
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(data) > LONG:
                self.known[piece] = self._heap(data)
            else:
                left.append((piece, data))
        at = 0
        while at < len(left):
            width = len(left[at][1])
            width += max(1, width // 4)  # a bucket of lengths
            end = at
            while end < len(left) and len(left[end][1]) <= width and (end - at) * width < _CELLS:
                end += 1
            pieces_here = left[at:end]
            self.known.update(zip((p for p, _ in pieces_here), self._matrix([d for _, d in pieces_here], width), strict=True))
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.split(t) for t in texts]
        new = set().union(*cut) - self.known.keys()
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set().union(*cut)
            self._learn(new)
        known = self.known
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def _codec(rank_path: str, pattern: str) -> Codec:
    """One codec for each Python worker; its table of pieces serves the worker's next tasks too."""
    return Codec(read_ranks(rank_path), pattern)


def roundtrip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: the ids (binary, little-endian 32 bits) and the bytes that they decode to."""

    def make():
        codec = _codec(rank_path, pattern)

        def run(batches):
            for ids, texts in in_text_chunks(batches, 1 << 20):
                coded = codec.encode([t.decode("utf-8", "replace") for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(coded, pa.binary()), pa.array([codec.decode(c) for c in coded], pa.binary())], ["doc_id", "ids", "decoded"]
                )

        return run

    return map_arrow(doc_bytes(docs), make, "doc_id long, ids binary, decoded binary")


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``."""
    return roundtrip(docs, rank_path, pattern).drop("decoded")


def decode(coded: DataFrame, rank_path: str) -> DataFrame:
    """``doc_id, decoded`` of ``doc_id, ids``; ids outside the table fail."""

    def make():
        tokens = {r: t for t, r in read_ranks(rank_path).items()}

        def run(batches):
            for batch in batches:
                texts = [b"".join([tokens[i] for i in np.frombuffer(x.as_py() or b"", "<u4").tolist()]) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

        return run

    return map_arrow(coded.selectExpr("cast(doc_id as long) doc_id", "ids"), make, "doc_id long, decoded binary")
