"""Words and word hashes of many texts at once, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, on UTF-8 bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), elementwise."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, _U), np.full(n, inverse, _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 20, 1 << (n - 1).bit_length()))


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a line feed after each text, and where each text starts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    return np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8), starts


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true; the last element must be false."""
    change = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    return change[0::2], change[1::2]


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``buf[start:end]``; equal bytes give equal hashes everywhere."""
    if not len(start):
        return np.zeros(0, _U)
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


class Words:
    """Words of a run of texts: ``start``, ``end`` in ``buf``, ``doc`` (index), ``first`` (per doc)."""

    def __init__(self, texts: list[bytes]):
        self.n_docs = len(texts)
        self.buf, self.text_start = join_texts(texts)
        self.start, self.end = spans(~SPACE[self.buf])
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.buf, self.start, self.end)


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles: (hash, doc index), by doc and then hash.

    A text of fewer words gives its whole sequence as one; one without words none.
    """
    w = words.hashes()
    a = _U(0xC2B2AE3D27D4EB4F)
    n = len(w)
    parts_h, parts_d = [], []
    if n >= size:
        h = np.zeros(n - size + 1, _U)
        for k in range(size):
            h = h * a + w[k : n - size + 1 + k]
        whole = words.doc[: n - size + 1] == words.doc[size - 1 :]
        parts_h.append(mix(h[whole]))
        parts_d.append(words.doc[: n - size + 1][whole])
    for k in range(1, size):
        short = np.flatnonzero(words.count == k)
        if len(short):
            h = np.full(len(short), k, _U)
            for j in range(k):
                h = h * a + w[words.first[short] + j]
            parts_h.append(mix(h ^ _U(0x5851F42D4C957F2D)))
            parts_d.append(short)
    if not parts_h:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h, d = np.concatenate(parts_h), np.concatenate(parts_d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]
