"""Prefix trie of conversations by Patricia construction.

A conversation is a sequence of turns; a turn is its role and text, known by a
128-bit hash. A node of the trie is a distinct sequence of first turns.

1. Conversations of equal sequences become one row (map-side combined), so a
   conversation that is copied a billion times is one sequence with a count.
2. The distinct sequences are sorted over ranges; in a range, what neighbours
   share is measured. Ranges tell the driver their first and last sequence and
   what these share with the rest of the range (depths only), from which follow
   the points of other ranges on their borders.
3. Each range walks its sequences with a stack and creates only branch, end and
   leaf points, with the bytes of the turns on the edge above them (compressed
   edges). Members, children, leaves, bytes of members and bytes of new nodes
   are all sums over the sequences below, so points that several ranges share
   are merged by one grouped sum.
4. Nodes with one child between points are expanded from the edges' suffix sums.

A conversation's turns (24 bytes each) are one row, as a text is; no task holds
more than one batch of them and one path. The list of members that end in a node
is hashed in chunks of neighbouring ids, joined in order, never held whole.

Results in odd cases. Turns are ordered by ``turn``, null first, ties by role and
hash, so that repeated rows are repeated turns; a null role or text is empty.
Rows with a null ``conv_id`` belong to no conversation and are left out. A
conversation of no turns ends in the root. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, shuffle_partitions

#: Ids of one chunk of ends are equal but for this many low bits.
CHUNK_BITS = 16
#: Points that a task sends on at once.
SENT = 2000
_POINT = pa.schema([
    ("point", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("member_bytes", pa.int64()), ("new_bytes", pa.int64()), ("above", pa.int64()), ("below", pa.list_(pa.int64())), ("seq", pa.string()),
])
_POINT_SQL = "point binary, parent binary, depth long, n_convs long, conv_id long, n_children long, n_leaves long, member_bytes long, new_bytes long, above long, below array<long>, seq string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` in order; a turn is ``a, b`` (its hash) and ``n`` (bytes of its text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    md5 = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring("m", at, 16), 16, -10).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), md5.alias("m"), F.octet_length(text).cast("long").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", half(1).alias("a"), half(17).alias("b"), "n")
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n"].alias("n"))).alias("turns"))


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Each conversation with its first ``head`` turns replaced by those of conversation ``base``.

    ``head`` is at most ``most``. All turns of a shorter base are taken, none of an absent one.
    """
    turns = materialize(turns, "trie-turns")
    heads = turns.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    joined = turns.withColumn("base", base).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", head + 1, F.greatest(F.size("turns") - head, F.lit(0)))
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("first", F.lit(1), head), none), own).alias("turns"))


def ends(members: DataFrame) -> DataFrame:
    """``seq, ends_sha256``: SHA-256 of the ascending, comma-joined ids of the conversations with one sequence."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = members.groupBy("seq", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(ids.cast("binary").alias("ids"))

    def make():
        def run(batches):
            at, sha = None, None
            for batch in batches:
                done = []
                for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if seq != at:
                        if at is not None:
                            done.append((at, sha.hexdigest()))
                        at, sha = seq, hashlib.sha256(ids)
                    else:
                        sha.update(b"," + ids)
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["seq", "ends_sha256"])
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sha.hexdigest()])], ["seq", "ends_sha256"])

        return run

    ordered = chunks.repartition(shuffle_partitions(members.sparkSession), "seq").sortWithinPartitions("seq", "chunk").select("seq", "ids")
    return map_arrow(ordered, make, "seq string, ends_sha256 string")


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def shared_turns(a: np.ndarray, b: np.ndarray) -> int:
    """Turns that two keys (two integers for each turn) begin with in common."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax() if differ.any() else n) // 2


def _sorted(sequences: DataFrame) -> DataFrame:
    """Sequences in ranges and order, with ``lcp`` to the one before in the range (-1 for the first).

    The last row of a range (``key`` null) holds the range's first and last key and the
    depths that each shares with sequences of the range.
    """
    parts = shuffle_partitions(sequences.sparkSession)
    ranged = sequences.repartitionByRange(parts, "key").sortWithinPartitions("key").select("seq", "conv_id", "n", "key", "bytes")

    def make():
        from pyspark import TaskContext

        def run(batches):
            part, pos, before, first = TaskContext.get().partitionId(), 0, None, None
            down, up = [], []  # depths shared with the first, running minimum; with the last, a stack
            for batch in batches:
                keys = _lists(batch.column(3))
                lcp = np.empty(len(keys), np.int64)
                for i, key in enumerate(keys):
                    if before is None:
                        first, lcp[i] = key.copy(), -1
                    else:
                        lcp[i] = d = shared_turns(before, key)
                        if not down or d < down[-1]:
                            down.append(d)
                        while up and up[-1] >= d:
                            up.pop()
                        up.append(d)
                    before = key
                n = batch.num_rows
                if n:
                    before = before.copy()
                    null = pa.nulls(n, pa.list_(pa.int64()))
                    here = [c.cast(pa.list_(pa.int64())) if pa.types.is_list(c.type) else c for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(pos, pos + n)), *here, pa.array(lcp), null, null, null, null], names)
                    pos += n
            if first is not None:
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (first, before, [*down, len(first) // 2], [*up, len(before) // 2])]
                blank = [pa.nulls(1, t) for t in (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pos]), *blank, *lists], names)

        return run

    names = ["part", "pos", "seq", "conv_id", "n", "key", "bytes", "lcp", "first", "last", "down", "up"]
    return materialize(map_arrow(ranged, make, "part long, pos long, seq string, conv_id long, n long, key array<long>, bytes array<long>, lcp long, first array<long>, last array<long>, down array<long>, up array<long>"), "trie-sorted")


def borders(ranges: list) -> dict[int, tuple[int, int, list[int], list[int]]]:
    """For each range: turns that its first sequence shares with the one before and its last with the one after
    (-1: there is none), and the depths of other ranges' points on those two sequences."""
    found = {r.part: [-1, -1, [], []] for r in ranges}
    pairs = list(zip(ranges, ranges[1:], strict=False))
    keys = {r.part: (np.array(r.first, np.int64), np.array(r.last, np.int64)) for r in ranges}
    for a, b in pairs:
        found[a.part][1] = found[b.part][0] = shared_turns(keys[a.part][1], keys[b.part][0])
    through = {r.part: shared_turns(*keys[r.part]) for r in ranges}
    reach: set[int] = set()  # depths that all before share with the last sequence
    for a, b in pairs:
        reach = set(a.up) | {min(d, through[a.part]) for d in reach}
        reach = {min(d, found[b.part][0]) for d in reach}
        found[b.part][2] = sorted(reach)
    reach = set()
    for a, b in reversed(pairs):
        reach = set(b.down) | {min(d, through[b.part]) for d in reach}
        reach = {min(d, found[a.part][1]) for d in reach}
        found[a.part][3] = sorted(reach)
    return {k: tuple(v) for k, v in found.items()}


class _Open:
    """A point on the present path."""

    __slots__ = ("depth", "since", "sha", "convs", "least", "children", "leaves", "member", "new", "seq")

    def __init__(self, depth: int, since: int, sha):
        self.depth, self.since, self.sha = depth, since, sha  # since: turns that its first sequence shared with the one before
        self.convs, self.least, self.children, self.leaves, self.member, self.new, self.seq = 0, None, 0, 0, 0, 0, None


def _points(ranged: DataFrame, border: dict) -> DataFrame:
    """Points of each range with their share of the sums."""
    shared = ranged.sparkSession.sparkContext.broadcast(border)  # depths on two sequences of each range
    parts = max(border, default=0) + 1
    rows = ranged.where("key IS NOT NULL").repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "pos").select("part", "seq", "conv_id", "n", "key", "bytes", "lcp")

    def make():
        def digest(above: _Open | None, raw: bytes, depth: int):
            sha = above.sha.copy() if above else hashlib.md5()
            sha.update(raw[16 * above.depth if above else 0 : 16 * depth])
            return sha

        def run(batches):
            out: list[tuple] = []
            stack: list[_Open] = []
            held = None  # the sequence whose points are on the stack

            def insert(depth: int, at: int, since: int, raw: bytes):
                stack.insert(at, _Open(depth, since, digest(stack[at - 1] if at else None, raw, depth)))

            def close(total: np.ndarray):
                """Take the deepest point off; its sums go to the one above."""
                v = stack.pop()
                above = stack[-1] if stack else None
                until = max(v.depth - 1, 0)
                if v.since < v.depth:
                    v.new += int(total[v.depth] - total[until])
                top = above.depth if above else -1
                edge = total[v.depth - 1] - total[top : v.depth] if above else np.zeros(1, np.int64)
                out.append((v.sha.digest(), above.sha.digest() if above else None, v.depth, v.convs, v.least, v.children, v.leaves, v.member, v.new, int(total[until]), edge, v.seq))
                if above:
                    above.convs += v.convs
                    above.least = v.least if above.least is None else min(above.least, v.least)
                    above.children += v.since <= above.depth
                    above.leaves += v.leaves
                    above.member += v.member
                    above.new += v.new + max(0, int(total[until] - total[min(max(v.since, above.depth), until)]))

            def take(row: tuple, after: int, left: list[int], right: list[int]):
                """Put the points of one sequence on the stack; ``after``: turns shared with the next one."""
                seq, conv, n, key, sizes, lcp = row
                raw, length = key.tobytes(), len(key) // 2
                total = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
                while stack and stack[-1].depth > lcp:
                    if len(stack) == 1 or stack[-2].depth < lcp:
                        insert(lcp, len(stack) - 1, stack[-1].since, raw)
                    close(held[1])
                for depth in sorted({0, length, *left, *right}):
                    at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].depth <= depth), -1)
                    if at < 0 or stack[at].depth < depth:
                        insert(depth, at + 1, stack[at + 1].since if at + 1 < len(stack) else lcp, raw)
                end = stack[-1]
                end.seq = seq
                end.convs += n
                end.least = conv if end.least is None else min(end.least, conv)
                end.leaves += after < length
                end.member += n * int(total[length])
                return raw, total

            def sent():
                batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _POINT, strict=True)], schema=_POINT)
                out.clear()
                return batch

            waiting, part = None, None
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 3, 6)]
                keys, sizes = _lists(batch.column(4)), _lists(batch.column(5))
                for at, seq, conv, n, lcp, key, size in zip(*columns, keys, sizes, strict=True):
                    if at != part:
                        if waiting:
                            held = take(waiting, shared.value[part][1], left, shared.value[part][3])
                            while stack:
                                close(held[1])
                        part, left, waiting = at, shared.value[at][2], None
                        lcp = shared.value[at][0]
                    if waiting:
                        held = take(waiting, lcp, left, [])
                        left = []
                    waiting = (seq, conv, n, key.copy(), size.copy(), lcp)
                    if len(out) >= SENT:
                        yield sent()
            if waiting:
                held = take(waiting, shared.value[part][1], left, shared.value[part][3])
                while stack:
                    close(held[1])
            if out:
                yield sent()

        return run

    return map_arrow(rows, make, _POINT_SQL)


def compressed(members: DataFrame) -> DataFrame:
    """Branch, end and leaf points of ``conv_id, seq, turns``.

    ``point, parent, depth, conv_id, n_convs, n_children, n_leaves, saved, below, seq``;
    ``below`` has, for each node of the edge down to the point, the bytes of the turns
    after it up to the turn before the point's; ``seq`` is set where conversations end.
    """
    key = F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"])))
    distinct = members.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("turns").alias("turns"))
    ranged = _sorted(distinct.select("seq", "conv_id", "n", key.alias("key"), F.col("turns.n").alias("bytes")))
    ranges = sorted(ranged.where("key IS NULL").select("part", "first", "last", "down", "up").collect())  # one row for each range
    partial = _points(ranged, borders(ranges))
    one = partial.groupBy("point").agg(
        *(F.first(c).alias(c) for c in ("parent", "depth", "above", "below")),
        F.min("conv_id").alias("conv_id"), F.max("seq").alias("seq"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "member_bytes", "new_bytes")),
    )
    saved = F.col("member_bytes") - F.col("n_convs") * F.col("above") - F.col("new_bytes")
    return materialize(one.select("point", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved"), "below", "seq"), "trie-points")


def trie(conversations: DataFrame) -> DataFrame:
    """All nodes of ``conv_id, turns``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (over the subtree, bytes of the last text of all members
    but one) and ``ends_sha256`` (of the members that end there).
    """
    seq = F.md5(F.array_join(F.transform("turns", lambda t: F.concat(F.hex(t["a"]), F.lit("."), F.hex(t["b"]))), ",").cast("binary"))
    members = materialize(conversations.select("conv_id", seq.alias("seq"), "turns"), "trie-members")
    points = compressed(members)
    above = points.select(F.col("point").alias("parent"), F.col("conv_id").alias("above_conv"))
    named = points.join(above, "parent", "left").join(ends(members.select("conv_id", "seq")), "seq", "left")
    nodes = named.select("*", F.posexplode("below").alias("at", "suffix"))
    last = F.col("at") == F.size("below") - 1
    return nodes.select(
        "conv_id",
        (F.col("depth") - F.size("below") + 1 + F.col("at")).alias("depth"),
        F.when(F.col("at") == 0, F.col("above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("suffix")).alias("saved_tokens"),
        F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
