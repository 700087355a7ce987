"""What a bucket of the language model holds."""

import tracemalloc

import numpy as np
import pyarrow.compute as pc

from touchline.llm import context_model, seating
from touchline.llm.textvec import Words


def test_contexts_take_few_bytes_a_token():
    """Restaurants of 300,000 tokens, of which a third follow one word, beside the tokens themselves."""
    rng = np.random.default_rng(0)
    n = 300_000
    y, z, w = (rng.zipf(1.3, n) % 50_000 for _ in range(3))
    z[: n // 3] = 5
    columns = [x.astype(np.uint64) for x in (y, z, w)]
    tracemalloc.start()
    model = context_model.Contexts(*columns, np.ones(n, np.uint8))
    held, most = (x / n for x in tracemalloc.get_traced_memory())
    tracemalloc.stop()
    want, first, at = np.unique(columns[1], return_index=True, return_inverse=True)
    assert all(np.array_equal(a, b) for a, b in zip(context_model._distinct(columns[1]), (want, first, at), strict=True))
    assert sum(model.n[0]) == n and held < 34 and most < 58  # bytes; 39 and 67 before


def test_dealt_tokens_take_few_bytes(spark):
    """Frequent words are dealt as numbers; every token comes back with its contexts."""
    rng = np.random.default_rng(1)
    words = rng.zipf(1.2, 200_000) % 30_000
    rows = [(i, b"1" + " ".join(f"w{x}" for x in part).encode()) for i, part in enumerate(np.split(words, 400))]
    often = [f"w{x}".encode() for x, n in zip(*np.unique(words, return_counts=True), strict=True) if n > 3]
    h = Words(often).hashes() >> np.uint64(16)
    shares = context_model.Shares(h[:0], np.zeros(0, np.int64), 1)
    code = context_model.Codes(h, shares, 200)
    codes = spark.sparkContext.broadcast(code)
    df = spark.createDataFrame(rows, "doc_id long, body binary").coalesce(1)
    dealt = context_model._deal(df, 200, shares, codes).toArrow()
    tokens = len(words) + len(rows)
    assert sum(len(a) for a in dealt["a"].to_pylist()) / tokens < 6.3  # bytes; 7.4 as hashes
    n = 0
    for b in range(200):
        model, _, _, _ = context_model._read(dealt.filter(pc.field("bucket") == b).to_batches(), code)
        n += model.n[0].sum()
        own = set((Words([f"w{x}".encode() for x in np.unique(words)]).hashes() >> np.uint64(16)).tolist()) | {int(context_model._END)}
        assert set(model.w.tolist()) <= own
    assert n == tokens


def test_dishes_are_drawn_alike_alone_and_together():
    rng = np.random.default_rng(2)
    n = rng.integers(2, 80, 3000)
    rest, p, key = rng.uniform(1, 500, 3000), 10.0 ** rng.uniform(-5, -1, 3000), rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    together = seating.draw_tables(n, rest, p, 0.8, key, 3)
    for size in (2, 9, 63, 64, 65, 67, 79):
        i = np.flatnonzero(n == size)
        assert len(i) and np.array_equal(seating.draw_tables(n[i], rest[i], p[i], 0.8, key[i], 3), together[i])
