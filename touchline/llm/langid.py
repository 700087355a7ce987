"""Language ID with bit-sliced Bloom filters over n-grams.

A slot of the filter holds a bit mask of languages, so that one probe (the AND
of ``HASHES`` slots) gives all languages whose profile holds an n-gram. Summed
over the n-grams of a text, the mask's bits make one hit count per language.
A language's false-positive rate is its share of set bits to the power of
``HASHES``; hit shares are corrected for it and the largest decides, ties going
to the language with more training text and then the lesser name.

Training counts the n-grams of all rows with a language, each task combining its
own, and keeps those that make up ``SHARE`` of all n-grams of their language (so at
most ``1 / SHARE`` of each language, without ranking them); at most ``LANGUAGES``
languages fit the mask (more raise ValueError).

Texts that are null or have no letter are ``und`` with score 0, as is every text
when nothing was learned. Otherwise the score is the corrected share of n-grams
that the decided language has (0 to 1). Texts are used whole, extra columns are
ignored, and repeated rows each give their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_text_chunks, map_arrow, materialize
from .textvec import mix

#: Share of its language's n-grams from which an n-gram is kept.
SHARE = 2e-5
#: Bits of the mask.
LANGUAGES = 62
HASHES = 3
SLOTS = 1 << 20
#: Text that is judged at a time; its n-grams take about 150 times as many bytes.
RUN_BYTES = 512 << 10
#: Distinct n-grams that a counting task holds before it sends them on.
_HELD = 1 << 20

_LETTER = np.full(256, 32, np.uint8)
for _b in [*range(97, 123), *range(128, 256)]:
    _LETTER[_b] = _b


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of 3 and 4 bytes, as integers, and the index of the text of each.

    Anything but letters counts as a blank; n-grams may begin and end with one.
    """
    lower = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    raw = np.frombuffer(b"  ".join([b"", *lower, b""]), np.uint8)
    lengths = np.fromiter(map(len, lower), np.int64, len(lower)) + 2
    of = np.repeat(np.arange(len(texts)), lengths)
    b = _LETTER[raw]
    n = len(of)
    c = b.astype(np.uint64)
    a0, a1, a2, a3 = c[:n], c[1 : n + 1], c[2 : n + 2], np.append(c[3 : n + 2], np.uint64(32))[:n]
    three = a0 << np.uint64(16) | a1 << np.uint64(8) | a2
    four = three << np.uint64(8) | a3 | np.uint64(1 << 40)
    letter = b != 32
    l1 = letter[1 : n + 1]
    l2 = letter[2 : n + 2]
    return np.concatenate([three[l1], four[l1 & l2]]), np.concatenate([of[l1], of[l1 & l2]])


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def _counts(rows: DataFrame) -> DataFrame:
    """``lang, gram, n`` with one row for each task and n-gram, of ``(lang, body)``."""

    def make():
        def run(batches):
            held: dict[str, list] = {}
            size = 0

            def combined():
                for lang, parts in held.items():
                    g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    g, at = np.unique(g, return_inverse=True)
                    yield lang, g, np.bincount(at, c).astype(np.int64)

            def flush():
                for lang, g, c in combined():
                    for i in range(0, len(g), 100_000):
                        part = g[i : i + 100_000].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(c[i : i + 100_000])], ["lang", "gram", "n"])

            for langs, texts in in_text_chunks(batches, RUN_BYTES):
                by: dict[str, list[bytes]] = {}
                for lang, text in zip(langs, texts, strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, some in by.items():
                    g, c = np.unique(grams(some)[0], return_counts=True)
                    held.setdefault(lang, []).append((g, c))
                    size += len(g)
                if size > _HELD:
                    held = {lang: [(g, c)] for lang, g, c in combined()}
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > _HELD // 2:
                        yield from flush()
                        held, size = {}, 0
            yield from flush()

        return run

    return map_arrow(rows, make, "lang string, gram long, n long")


class Filters:
    """The bit-sliced filters of several languages."""

    def __init__(self, profiles: dict[str, np.ndarray], weight: dict[str, int]):
        self.names = sorted(profiles, key=lambda x: (-weight[x], x))
        if len(self.names) > LANGUAGES:
            raise ValueError(f"{len(self.names)} languages; the mask holds {LANGUAGES}")
        self.slots = np.zeros(SLOTS, np.uint64)
        for bit, name in enumerate(self.names):
            for at in self._places(profiles[name].astype(np.uint64)):
                np.bitwise_or.at(self.slots, at, np.uint64(1 << bit))
        fill = np.array([np.count_nonzero(self.slots & np.uint64(1 << bit)) / SLOTS for bit in range(len(self.names))])
        self.false = fill**HASHES

    @staticmethod
    def _places(gram: np.ndarray) -> list[np.ndarray]:
        h = mix(gram)
        return [(h >> np.uint64(20 * k) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """The languages that may hold each n-gram."""
        first, *rest = self._places(gram)
        out = self.slots[first]
        for at in rest:
            out &= self.slots[at]
        return out

    def decide(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        gram, of = grams(texts)
        mask = self.masks(gram)
        total = np.bincount(of, minlength=len(texts))
        share = np.empty((len(self.names), len(texts)))
        for bit in range(len(self.names)):
            hits = np.bincount(of, (mask >> np.uint64(bit) & np.uint64(1)).astype(np.float64), len(texts))
            raw = hits / np.maximum(total, 1)
            share[bit] = np.clip((raw - self.false[bit]) / (1 - self.false[bit]), 0, 1)
        best = share.argmax(axis=0)
        for i, text in enumerate(texts):
            if has_letter(text):
                names[i], scores[i] = self.names[best[i]], float(share[best[i], i])
        return names, scores


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters learned from all rows of ``docs`` whose language is not null."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("body"))
    counted = materialize(_counts(rows).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-counts")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("all")).limit(LANGUAGES + 1).collect()
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not totals:
        return Filters({}, {})
    least = F.create_map(*(F.lit(x) for r in totals for x in (r.lang, SHARE * r["all"])))
    # At most 1 / SHARE rows for each of at most LANGUAGES languages.
    found = counted.where(F.col("n") >= F.element_at(least, F.col("lang"))).toPandas()
    by = dict(iter(found.groupby("lang")))
    return Filters({k: v.gram.to_numpy() for k, v in by.items()}, {k: int(v.n.sum()) for k, v in by.items()})


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``; nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS words, whatever the input

    def make():
        model = shared.value

        def run(batches):
            for ids, texts in in_text_chunks(batches, RUN_BYTES):
                names, scores = model.decide(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

        return run

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body")), make, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, filters: Filters, least: float, columns: list[str]) -> DataFrame:
    """The rows whose language is known with a score of ``least`` at least, in ``columns``.

    Rows are judged where they lie and passed on or not, in slices of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(*columns)
    at = columns.index("text")

    def make():
        model = shared.value

        def run(batches):
            for batch in batches:
                sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0))
                start = 0
                while start < len(sizes):
                    end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), RUN_BYTES)))
                    part = batch.slice(start, end - start)
                    names, scores = model.decide([(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(at)])
                    kept = part.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))
                    if kept.num_rows:
                        yield kept
                    start = end

        return run

    return map_arrow(rows, make, rows.schema)
