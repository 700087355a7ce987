"""The search by fingerprints: all votes, in blocks, against ``align`` of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import chroma


def _flipped(rng, codes, bits):
    """``codes`` with so many bits of each changed."""
    return np.array([int(c) ^ sum(1 << int(b) for b in rng.choice(32, n, replace=False)) for c, n in zip(codes, bits, strict=True)], np.uint32)


@pytest.mark.parametrize("block", [None, 300])
def test_lone_votes_between_unlike_neighbours_are_verified(spark, monkeypatch, block):
    """Pairs with one equal integer whose neighbours differ in 64 of 128 bits, in 23 % of all; with small blocks too."""
    if block:
        monkeypatch.setattr(chroma, "BLOCK", block, raising=False)
    codes = F.col("media")
    monkeypatch.setattr(chroma, "fingerprint", lambda r: r.select("rec_id", (F.octet_length(codes) / 4).cast("long").alias("n_frames"), codes.alias("codes"), F.sha2(codes, 256).alias("cls")))
    rng = np.random.default_rng(3)
    rows, unlike = {}, np.full(60, 7)
    unlike[[18, 24, 36, 42]], unlike[30] = 16, 0
    for k in range(3):
        own = rng.integers(0, 1 << 32, 60).astype(np.uint32)
        rows |= {20 * k: own, 20 * k + 1: _flipped(rng, own, unlike), 20 * k + 2: rng.integers(0, 1 << 32, 60).astype(np.uint32)}
    rows |= {3: rows[0], 40: np.r_[rows[40], rows[0]]}
    frame = spark.createDataFrame([(k, bytes(v.astype("<u4").tobytes())) for k, v in rows.items()], "rec_id long, media binary").repartition(3)
    got = {r.rec_id: r for r in chroma.match(frame).collect()}
    classes = {v.tobytes(): k for k, v in sorted(rows.items(), reverse=True)}
    assert len(got) == len(rows) and got[3].class_id == 0 and got[0].class_size == 2
    for q in (0, 20, 40):
        found = [(at[1], k, at[0]) for c, k in classes.items() if k != q and (at := chroma.align(rows[q], np.frombuffer(c, "<u4"))) and at[1] <= chroma.MAX_ERROR]
        assert found and got[q].n_matches == len(found)
        assert (got[q].best_error, got[q].best_id, got[q].best_offset) == min(found)


@pytest.mark.parametrize("votes, common", [(50, 2), (3000, 7), (1 << 18, 1000)])
def test_matches_are_those_of_align(monkeypatch, votes, common):
    """Few integers, long runs and silence, however the votes are cut."""
    rng = np.random.default_rng(1)
    some = np.r_[chroma.SILENT, rng.integers(0, 1 << 32, 5)].astype(np.uint32)
    codes = [np.repeat(some[rng.integers(0, 6, rng.integers(0, 60))], rng.integers(1, 5)) for _ in range(30)]
    want = {(q, c): at[:2] for q, a in enumerate(codes) for c, b in enumerate(codes) if (at := chroma.align(a, b)) and at[1] <= chroma.MAX_ERROR}
    monkeypatch.setattr(chroma, "VOTES", votes)
    monkeypatch.setattr(chroma, "COMMON", common)
    got = [row for found in chroma.matches(codes[:25], codes) for row in zip(*(x.tolist() for x in found), strict=True)]
    assert len(want) > 10 and {(q, c): (offset, error) for q, c, offset, error in got} == {k: v for k, v in want.items() if k[0] < 25}
    assert len({row[:2] for row in got}) == len(got)
    assert not list(chroma.matches([], codes)) and not [r for found in chroma.matches(codes, []) for r in found[0]]
