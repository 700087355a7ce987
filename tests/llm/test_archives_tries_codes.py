"""WARC assembly, conversation tries and vector codes against brute force on small odd tables."""

import base64
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import prefix_trie, queries, vector_codes, warc

CLASH = ("row", "key", "seq", "n", "point", "depth", "code", "ints", "capture", "body", "turns", "part", "a", "b", "error", "label_error")


def table(spark, tmp_path, name, rows, schema, parts=3):
    """Written as a given table would be, with clashing extra columns."""
    df = spark.createDataFrame(rows, schema).repartition(parts)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


# --- archives --------------------------------------------------------------------

def test_warc_query(spark, tmp_path):
    pages = [
        (5, "http://a.org/x y?q=1#z", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "no scheme", None), (8, "http://b.org/\r\nX: 1", ""), (7, "http://b.org", "WARC/1.1\r\n\r\n\r\nWARC-Type: response\r\n"),
        (None, "http://n.org", "<p>é</p>"), (2, "http://c.org", "long " * 60_000), (1, "http://t.org", "one"), (1, "http://t.org", "one"), (4, "http://t.org", "one"), (None, None, None), (6, "http://c.org", "  "),
    ]
    d = table(spark, tmp_path, "pages", pages, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in queries.op11_warc(spark, d).collect()), key=repr)
    want, seen = [], {}
    for page, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        body = (html or "").encode()
        again = body in seen
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", seen.get(body) if again else None))
        seen.setdefault(body, page)
    assert got == sorted(want, key=repr)


def test_warc_empty(spark, tmp_path):
    assert queries.op11_warc(spark, table(spark, tmp_path, "pages", [], "page_id long, url string, html string")).collect() == []


def test_warc_files_and_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/{k}", ("same" if k % 4 == 0 else f"page {k} ") * (k + 1 if k % 4 else 9)) for k in range(60)], "page_id long, url string, html string").repartition(2)
    files = warc.write_archives(pages, f"file://{tmp_path}/warc", least_bytes=5, file_bytes=4000)
    assert files.count() > 3 and files.agg(F.sum("n_records")).first()[0] == 180
    found = warc.captures(warc.read_records(spark, files))
    full = by(warc.with_payloads(found, spark, files), "page_id")
    want = {r.page_id: r.html for r in pages.collect()}
    assert {k[0]: bytes(r.payload).decode() for k, r in full.items()} == want
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 and r.intact in (True, None) for r in full.values())
    assert full[(4,)].record_type == "revisit" and full[(4,)].original.page_id == 0 and full[(4,)].target_uri == "http://h1.org/4"
    small = warc.write_archives(pages, f"file://{tmp_path}/all", least_bytes=1 << 20)
    assert warc.captures(warc.read_records(spark, small, payloads=False)).where("record_type = 'revisit'").count() == 0


def test_warc_of_others(spark, tmp_path):
    """Chains, links of the response itself, two captures, a cycle without a response; plain files and gzip."""
    when = "2020-02-02T00:00:00Z"
    rec = lambda kind, name, links=(), block=b"x", kind_of="text/plain": warc.record(kind, f"<{name}>", block, kind_of, when, [("WARC-Concurrent-To", f"<{k}>") for k in links])
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    one = b"".join([
        rec("warcinfo", "w"), rec("response", "r1", ["q1"], http, "application/http; msgtype=response"), rec("request", "q1"), rec("metadata", "m1", ["q1"], b"page-id: 12\r\nnote: a\r\n b\r\n", "application/warc-fields"),
        rec("metadata", "m2", ["m1"]), rec("metadata", "both", ["r2", "r1"]),
    ])
    two = b"".join([rec("resource", "r2", block=b"plain"), rec("request", "c1", ["c2"]), rec("metadata", "c2", ["c1"]), rec("request", "lone"), rec("metadata", "lost", ["nowhere"])])
    (tmp_path / "one.warc").write_bytes(one)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(two[:40]) + gzip.compress(two[40:]))
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("one.warc", "two.warc.gz")], "path string")
    got = by(warc.captures(warc.read_records(spark, files)), "capture")
    assert len(got) == 5
    first = got[("<r1>",)]
    assert [q.record_id for q in first.requests] == ["<q1>"] and sorted(m.record_id for m in first.metadata) == ["<both>", "<m1>", "<m2>"]
    assert (first.page_id, first.payload_bytes, first.response.http_head) == (12, 4, "HTTP/1.1 200 OK")
    assert got[("<r2>",)].payload_bytes == 5 and got[("<r2>",)].requests == []
    rest = {tuple(sorted(x.record_id for x in [*r.requests, *r.metadata])) for k, r in got.items() if r.record_type is None}
    assert rest == {("<c1>", "<c2>"), ("<lone>",), ("<lost>",)}
    (tmp_path / "cut.warc").write_bytes(one[:-9])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(open(tmp_path / "cut.warc", "rb", buffering=0)))


# --- tries -----------------------------------------------------------------------

def brute_trie(conversations):
    """The contract's nodes from dictionaries."""
    own = {}
    for conv, turn, role, text in sorted((r for r in conversations if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    size = lambda node: (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = size(node) + sum(saved[k] for k in below)
    return sorted(
        (
            (min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids.get(node, [])), leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, sorted(c for c in cs if built[c] == node))).encode()).hexdigest())
            for node, cs in members.items()
        ),
        key=repr,
    )


def random_conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(most)):
            rows.append((c * rng.choice([1, 1, 1, 3]) + rng.randrange(2) * 70_000, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", rng.choice(["a", "a", "a", "é" * 3, "b"])))
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize(("seed", "n", "most", "parts"), [(1, 60, 5, 1), (2, 150, 4, 7), (3, 40, 14, 40), (4, 300, 3, 5), (5, 9, 2, 4)])
def test_trie_query(spark, tmp_path, seed, n, most, parts):
    rows = random_conversations(seed, n, most)
    d = table(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((tuple(r) for r in queries.op12_conv_trie(spark, d).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute_trie(rows)


def test_trie_odd(spark, tmp_path):
    """Null ids, turns, roles and texts; negative ids; an absent base; a conversation that loses all its turns; a long one; repeats."""
    rows = [(None, 1, "u", "x"), (1, None, None, None), (1, 0, "u", ""), (-3, 1, "u", "x"), (-5, 4, "u", "y"), (11, 1, "u", "x"), (12, 1, None, "x" * 200_000), (7, 2, "u", "z"), (7, 1, "u", "y"), (5, 1, "u", "q"), (3, 3, "u", "t"), (3, 3, "u", "t")]
    rows += [(20, t, "u", "w") for t in range(700)] + [(21, t, "u", "w") for t in range(700)] + [(22, t, "u", "w") for t in range(650)]
    d = table(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in queries.op12_conv_trie(spark, d).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_empty(spark, tmp_path):
    assert queries.op12_conv_trie(spark, table(spark, tmp_path, "conversations", [], "conv_id long, turn long, role string, text string")).collect() == []


def test_trie_keeps_few_points(spark):
    """Only branch, end and leaf points are made: two long conversations that part near the end give four."""
    rows = [(c, t, "u", f"{t}" if t < 90 else f"{t}{c}") for c in (1, 2) for t in range(100)]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    members = turns.withColumn("seq", F.col("conv_id").cast("string"))
    points = by(prefix_trie.compressed(members), "depth", "conv_id")
    assert sorted(points) == [(0, 1), (90, 1), (100, 1), (100, 2)]
    assert points[(90, 1)].saved == len("89")


# --- codes -----------------------------------------------------------------------

def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    width = len(kept[0][1])
    limit = vector_codes.largest(width)
    fine = [k for k in kept if len(k[1]) == width and all(abs(x) <= limit for x in k[1])]
    if width % parts:
        fine = []
    size = width // parts
    cut = lambda v, p: v[p * size : p * size + size]
    books = [[cut(v, p) for _, v, _ in fine[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v, p: min(range(len(books[p])), key=lambda e: (dist(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            sums = {}
            for _, v, _ in fine:
                sums.setdefault(assign(v, p), []).append(cut(v, p))
            books[p] = [[sum(c) // len(sums[e]) for c in zip(*sums[e], strict=True)] if e in sums else b for e, b in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        if (i, v, lab) in fine:
            code = [assign(v, p) for p in range(parts)]
            out.append([i, bytes(code).hex(), sum(dist(cut(v, p), books[p][e]) for p, e in enumerate(code)), lab])
        else:
            out.append([i, None, None, lab])
    total = {}
    for _, _, e, lab in out:
        if e is not None:
            total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, total.get(lab), sha) for i, c, e, lab in out], books


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_query(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([rng.gauss(0, 1), -0.5, 0.0, 0.25]) for _ in range(32)], rng.choice([None, 1, 2])) for k in range(90)]
    rows += [rows[4]] * 40 + [(200, None, 1), (-1, [math.nan] + [0.0] * 31, 1), (-2, [None] + [0.0] * 31, 1), (-3, [math.inf] + [0.0] * 31, 2), (300, [1.0] * 31, 2), (301, [], 5), (302, [1e30] * 32, 1), (None, [0.5] * 32, None), (3, [0.75] * 32, 9)]
    rows = [(i, None if v is None else [None if x is None else np.float32(x).item() for x in v], lab) for i, v, lab in rows]
    d = table(spark, tmp_path, "embeddings", rows, SCHEMA)
    got = sorted((tuple(r) for r in queries.op13_vector_codes(spark, d).collect()), key=repr)
    assert got == sorted(brute_codes(rows)[0], key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1), (2, [], None)], [(2, [1.0] * 17, 1)], [(1, [0.5] * 16, None)]])
def test_codes_odd(spark, tmp_path, rows):
    d = table(spark, tmp_path, "embeddings", rows, SCHEMA, 1)
    got = sorted((tuple(r)[:4] for r in queries.op13_vector_codes(spark, d).collect()), key=repr)
    assert got == sorted((r[:4] for r in brute_codes(rows)[0]), key=repr)


def test_codes_decode(spark):
    rows = [(k, [k % 4 / 4] * 8 + [k % 2 * 1.0] * 8, 0) for k in range(8)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), parts=4, entries=8, rounds=1)
    back = by(vector_codes.decode(coded, books), "vec_id")
    assert all(back[(k,)].vector == v and back[(k,)].error == 0 for k, v, _ in rows)
