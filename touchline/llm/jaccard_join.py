"""N-gram Jaccard join: word-shingle sets, linked where Jaccard is 0.8 or more.

Result: the connected components of all links, one row for each document. The
join is exact up to 64-bit hashes of shingles and sets. Steps, all of them linear
in the text but for what links:

1. *Sets.* Each text becomes its set of shingle hashes; equal sets make one class.
   A summary of bounded size (Misra-Gries, mergeable) finds the very frequent
   shingles, so that no bucket of the next step gets more than its fair share.
2. *Frequencies.* Shingles are dealt to buckets by hash, packed; a bucket sees all
   classes of a shingle and returns to each class those of its shingles that some
   other class has, with their frequency.
3. *Global order and prefixes.* Order: rarest first. A set of ``n`` has a partner
   only if it shares one of its first ``n - ceil(0.8 n) + 1``; shingles of one
   class only come first in it and cannot be shared. Most sets end here.
4. *Candidate groups.* Classes that share a prefix shingle are connected (a star
   around the least class of a shingle, combined on the map side); connected
   classes make a group. No pairs are made.
5. *Trie join.* Within a group the sets, in one order, are put into a trie whose
   shared paths are compared once. Each set walks it with the overlap so far and
   leaves a subtree when the bound by what remains on either side is too low, or
   when all of it is already in the same component. A group larger than
   ``GROUP_SETS`` sets is dealt as pairs of blocks, so no task holds all of it;
   blocks' components are connected again.
6. *Components* of the links give each document the least id it can reach.

A null or empty text, or one without words, has an empty set and is linked with
nothing. Rows with the same id take part each; the least id names the component.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bytes, in_text_chunks, map_arrow, materialize, row_hash, shuffle_partitions, without_rows
from .components import connect
from .textvec import Words, mix, shingle_hashes

#: Shingles that a bucket should hold.
BUCKET_SHINGLES = 3 << 20
#: Sets of a candidate group that one task joins.
GROUP_SETS = 20_000
_LOW = np.uint64((1 << 48) - 1)


def links(overlap: int, a: int, b: int, percent: int) -> bool:
    """100 * |intersection| >= percent * |union|."""
    return 100 * overlap >= percent * (a + b - overlap)


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and their text, by text; number of shingles and class of each text."""
    h, d = shingle_hashes(Words(texts), size)
    n = np.bincount(d, minlength=len(texts))
    first = np.cumsum(n) - n
    padded = np.append(mix(h + np.uint64(0x2545F4914F6CDD1D)), np.uint64(0))
    total = np.concatenate([[np.uint64(0)], np.cumsum(padded, dtype=np.uint64)])
    cls = mix((total[first + n] - total[first]) ^ n.astype(np.uint64)).view(np.int64)
    return h, d, n, cls


def _packed(values: np.ndarray, offsets: np.ndarray, width: int) -> pa.Array:
    """A binary array of slices of ``values``, without a copy for each."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column and how many each row has."""
    data = b"".join(x.as_py() or b"" for x in column)
    items = np.frombuffer(data, kind)
    size = np.fromiter((len(x.as_py() or b"") for x in column), np.int64, len(column)) // np.dtype(kind).itemsize
    return items, size


class Frequent:
    """Misra-Gries summary: items with more than 1/size of all, at most ``size`` of them."""

    def __init__(self, size: int):
        self.size, self.items, self.counts = size, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, items: np.ndarray) -> None:
        new, n = np.unique(items, return_counts=True)
        every, at = np.unique(np.concatenate([self.items, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, n])).astype(np.int64)
        if len(every) > self.size:
            cut = np.partition(counts, len(counts) - self.size - 1)[len(counts) - self.size - 1]
            live = counts > cut
            every, counts = every[live], counts[live] - cut
        self.items, self.counts = every, counts


def _survey(rows: DataFrame, size: int, summary: int) -> DataFrame:
    """``kind 0: doc_id, n, cls`` for each row; ``kind 1: item (cls), n`` of each task's summary."""

    def make():
        def run(batches):
            seen = Frequent(summary)
            for ids, texts in in_text_chunks(batches):
                h, _, n, cls = _sets(texts, size)
                seen.add(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), pa.array(ids, pa.int64()), pa.array(n), pa.array(cls)], ["kind", "doc_id", "n", "cls"])
            if len(seen.items):
                k = len(seen.items)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(seen.counts), pa.array(seen.items.view(np.int64))], ["kind", "doc_id", "n", "cls"])

        return run

    return map_arrow(rows, make, "kind int, doc_id long, n long, cls long")


def _deal(rows: DataFrame, size: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Packed shingles by bucket: ``bucket, kind, low (48 bits), of (16 bits), cls, n``.

    One row for each run of texts and bucket; ``cls`` and ``n`` list the run's
    classes, ``of`` points into them. Equal sets of a run are sent once. Rows of
    kind 1 hold a class's very frequent shingles and pass the bucket unread.
    """
    shared = rows.sparkSession.sparkContext.broadcast(hot)  # bounded by the summary's size

    def make():
        frequent = shared.value

        def run(batches):
            for _, texts in in_text_chunks(batches):
                if len(texts) > 60_000:
                    halves = [texts[i : i + 60_000] for i in range(0, len(texts), 60_000)]
                else:
                    halves = [texts]
                for part in halves:
                    yield from deal(part)

        def deal(texts):
            h, d, n, cls = _sets(texts, size)
            _, once = np.unique(cls, return_index=True)
            lead = np.zeros(len(texts), bool)
            lead[once] = True
            ok = lead[d]
            h, d = h[ok], d[ok]
            if not len(h):
                return
            at = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
            is_hot = frequent[at] == h if len(frequent) else np.zeros(len(h), bool)
            if is_hot.any():
                hh, hd = h[is_hot], d[is_hot]
                who, count = np.unique(hd, return_counts=True)
                offsets = np.concatenate([[0], np.cumsum(count)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((cls[who].view(np.uint64) % np.uint64(buckets)).astype(np.int32)),
                        pa.array(np.ones(len(who), np.int32)),
                        _packed(hh, offsets, 8),
                        pa.array([b""] * len(who), pa.binary()),
                        _packed(cls[who], np.arange(len(who) + 1), 8),
                        _packed(n[who].astype(np.int32), np.arange(len(who) + 1), 4),
                    ],
                    ["bucket", "kind", "low", "of", "cls", "n"],
                )
                h, d = h[~is_hot], d[~is_hot]
                if not len(h):
                    return
            bucket = ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, d, bucket = h[order], d[order], bucket[order]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            end = np.r_[start[1:], len(h)]
            low = h.view(np.uint8).reshape(-1, 8)[:, :6]
            rows_ = {"bucket": bucket[start], "kind": np.zeros(len(start), np.int32), "low": [], "of": [], "cls": [], "n": []}
            for s, e in zip(start, end, strict=True):
                who, of = np.unique(d[s:e], return_inverse=True)
                rows_["low"].append(low[s:e].tobytes())
                rows_["of"].append(of.astype("<u2").tobytes())
                rows_["cls"].append(cls[who].tobytes())
                rows_["n"].append(n[who].astype("<i4").tobytes())
            yield pa.RecordBatch.from_pydict(rows_)

        return run

    return map_arrow(rows, make, "bucket int, kind int, low binary, of binary, cls binary, n binary").repartitionById(buckets, "bucket")


_SHARED = "part int, cls binary, n binary, held binary, token binary, df binary"


def _shared_shingles(dealt: DataFrame, buckets: int) -> DataFrame:
    """``part, cls, n, held, token, df``: what classes share with others, packed by the classes' part.

    A row lists classes with their sizes and how many (``held``) of the row's
    shingles each has, so that a bucket makes one row for each part at most.
    """

    def make():
        def packed(classes, sizes, token, owner, df):
            """One row for each part, of entries whose ``owner`` indexes the classes."""
            part = (classes.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((owner, part[owner]))
            token, owner, df = token[order], owner[order], df[order]
            who, held = np.unique(part[owner].astype(np.int64) << 32 | owner, return_counts=True)
            at, who = who >> 32, who & 0xFFFFFFFF
            parts, first = np.unique(at, return_index=True)
            edge = np.r_[first, len(who)]
            cut = np.r_[0, np.cumsum(held)][edge]
            return pa.RecordBatch.from_arrays(
                [pa.array(parts.astype(np.int32)), _packed(classes[who], edge, 8), _packed(sizes[who].astype("<i4"), edge, 4), _packed(held.astype("<i4"), edge, 4), _packed(token, cut, 8), _packed(df, cut, 4)], schema=shape
            )

        def run(batches):
            token, owner, classes, sizes, base = [], [], [], [], 0
            for batch in batches:
                bucket, kind = (np.asarray(batch.column(i)) for i in (0, 1))
                for i in range(len(kind)):
                    low, of, cls, n = (batch.column(k)[i].as_py() for k in range(2, 6))
                    if kind[i]:
                        hot = np.frombuffer(low, "<u8")
                        yield packed(np.frombuffer(cls, "<i8"), np.frombuffer(n, "<i4"), hot, np.zeros(len(hot), np.int64), np.full(len(hot), np.iinfo(np.int32).max, "<i4"))
                        continue
                    cells = np.zeros((len(of) // 2, 8), np.uint8)
                    cells[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
                    # The bucket stands for the hash's high bits.
                    token.append(cells.view("<u8").ravel() | np.uint64(int(bucket[i]) << 48))
                    owner.append(np.frombuffer(of, "<u2").astype(np.int64) + base)
                    classes.append(np.frombuffer(cls, "<i8"))
                    sizes.append(np.frombuffer(n, "<i4"))
                    base += len(classes[-1])
            if not token:
                return
            token, owner, classes, sizes = map(np.concatenate, (token, owner, classes, sizes))
            classes, first, to = np.unique(classes, return_index=True, return_inverse=True)
            sizes, owner = sizes[first], to[owner]
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            again = np.zeros(len(token), bool)
            again[1:] = token[1:] == token[:-1]
            again[:-1] |= again[1:]
            token, owner = token[again], owner[again]
            order = np.lexsort((owner, token))  # copies of a class in other runs
            token, owner = token[order], owner[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            token, owner = token[new], owner[new]
            _, at, df = np.unique(token, return_inverse=True, return_counts=True)
            df = df[at].astype("<i4")
            ok = df > 1
            if ok.any():
                yield packed(classes, sizes, token[ok], owner[ok], df[ok])

        shape = pa.schema([("part", pa.int32()), *((k, pa.binary()) for k in ("cls", "n", "held", "token", "df"))])
        return run

    return map_arrow(dealt, make, _SHARED)


def _groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[int, list[list]]]:
    """Runs of rows with the same key of batches that are sorted by it."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def _prefixes(shared: DataFrame, percent: int, parts: int) -> DataFrame:
    """``cls, n, token, k``: sets that can have a partner, in global order; the first ``k`` are the shared part of the prefix."""

    def make():
        def run(batches):
            columns = [[] for _ in range(5)]
            for batch in batches:
                for column, i, kind in zip(columns, range(1, 6), ("<i8", "<i4", "<i4", "<u8", "<i4"), strict=True):
                    column.append(_flat(batch.column(i), kind)[0])
            if not columns[0]:
                return
            cls, n, held, token, df = map(np.concatenate, columns)
            cls, n = np.repeat(cls, held), np.repeat(n, held)
            order = np.lexsort((token, df, cls))
            cls, n, token = cls[order], n[order], token[order]
            new = np.ones(len(cls), bool)  # a very frequent shingle comes once for each run of texts
            new[1:] = (cls[1:] != cls[:-1]) | (token[1:] != token[:-1])
            cls, n, token = cls[new], n[new].astype(np.int64), token[new]
            first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
            end = np.r_[first[1:], len(cls)]
            size = n[first]
            k = size - -(-percent * size // 100) + 1 - (size - (end - first))
            for i in range(0, len(first), 2000):
                at = [j for j in range(i, min(len(first), i + 2000)) if k[j] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(cls[first[at]]), pa.array(size[at].astype(np.int32)), pa.array([token[first[j] : end[j]].tobytes() for j in at], pa.binary()), pa.array(k[at].astype(np.int32))], ["cls", "n", "token", "k"])

        return run

    return map_arrow(shared.repartitionById(parts, "part"), make, "cls long, n int, token binary, k int")


def _candidate_edges(sets: DataFrame, buckets: int) -> DataFrame:
    """``a, b``: a star of classes around the least class of each prefix shingle."""

    def star(token: np.ndarray, cls: np.ndarray):
        """Edges to the least class of each shingle; the shingles and those classes."""
        order = np.lexsort((cls, token))
        token, cls = token[order], cls[order]
        first = np.r_[True, token[1:] != token[:-1]]
        least = cls[first][np.cumsum(first) - 1]
        other = cls != least
        return np.unique(np.stack([cls[other], least[other]]), axis=1), token[first], cls[first]

    shape = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def local():
        def run(batches):
            for batch in batches:
                token, size = _flat(batch.column(2), "<u8")
                k = np.asarray(batch.column(3))
                first = np.cumsum(size) - size
                within = np.arange(len(token)) - np.repeat(first, size)
                ok = within < np.repeat(k, size)
                edges, token, cls = star(token[ok], np.repeat(np.asarray(batch.column(0)), size)[ok])
                if edges.shape[1]:
                    yield pa.RecordBatch.from_pydict({"bucket": [int(edges[0, 0] % buckets)], "kind": [0], "a": [edges[0].tobytes()], "b": [edges[1].tobytes()]}, schema=shape)
                bucket = (mix(token) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                token, cls, bucket = token[order], cls[order], bucket[order]
                which, count = np.unique(bucket, return_counts=True)
                offsets = np.r_[0, np.cumsum(count)]
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.ones(len(which), np.int32)), _packed(token, offsets, 8), _packed(cls, offsets, 8)], schema=shape)

        return run

    def merged():
        def run(batches):
            token, cls, edges = [], [], []
            for batch in batches:
                for kind, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    if kind:
                        token.append(np.frombuffer(a, "<u8"))
                        cls.append(np.frombuffer(b, "<i8"))
                    else:
                        edges.append(np.stack([np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")]))
            if token:
                edges.append(star(np.concatenate(token), np.concatenate(cls))[0])
            if edges:
                every = np.unique(np.concatenate(edges, axis=1), axis=1)
                for i in range(0, every.shape[1], 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(every[0, i : i + 50_000]), pa.array(every[1, i : i + 50_000])], ["a", "b"])

        return run

    dealt = map_arrow(sets, local, "bucket int, kind int, a binary, b binary").repartitionById(buckets, "bucket")
    return map_arrow(dealt, merged, "a long, b long")


class _Node:
    __slots__ = ("items", "children", "sets", "any", "least", "rest", "same")

    def __init__(self, items: np.ndarray):
        self.items = items  # the part of the path from the parent to here
        self.children: dict[int, _Node] = {}
        self.sets: list[int] = []  # sets that end here
        self.any = -1  # some set at or below
        self.least = 1 << 60  # size of the smallest set at or below
        self.rest = 0  # items below, on the longest path
        self.same = True  # all at or below in one component, when last looked at


class Trie:
    """Sets in one global order, joined one after the other; keeps components."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], percent: int, parent: np.ndarray | None = None):
        self.percent, self.sizes = percent, sizes
        self.parent = list(range(len(sets))) if parent is None else parent.tolist()
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        # Most frequent first: sets that are alike share long paths. Items of one set cannot be shared.
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort((np.arange(len(count)), -count))] = np.arange(len(count))
        self.sets, i = [], 0
        for s in sets:
            here = at[i : i + len(s)]
            self.sets.append(np.sort(rank[here[count[here] > 1]]))
            i += len(s)
        self.held = np.zeros(len(count) + 1, bool)
        self.root = _Node(np.zeros(0, np.int64))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def _link(self, node: _Node, x: int, overlap: int) -> None:
        for y in node.sets:
            if self.find(y) != self.find(x) and links(overlap, self.sizes[x], self.sizes[y], self.percent):
                self.union(x, y)

    def _walk(self, x: int) -> None:
        """Link ``x`` with the sets of the trie; kept on a stack, as paths may be long."""
        items, n = self.sets[x], self.sizes[x]
        self._link(self.root, x, 0)
        stack = [(self.root, 0, iter(self.root.children.values()))]
        while stack:
            node, overlap, children = stack[-1]
            for child in children:
                if child.same and self.find(child.any) == self.find(x):
                    continue
                here = overlap + int(self.held[child.items].sum())
                gone = int(np.searchsorted(items, child.items[-1], "right"))
                bound = here + min(len(items) - gone, child.rest)
                if links(bound, n, max(child.least, bound), self.percent):
                    self._link(child, x, here)
                    stack.append((child, here, iter(child.children.values())))
                    break
            else:
                self._look(node)
                stack.pop()

    def _look(self, node: _Node) -> None:
        root = self.find(node.any)
        node.same = all(self.find(y) == root for y in node.sets) and all(c.same and self.find(c.any) == root for c in node.children.values())

    def probe(self, x: int) -> None:
        self.held[self.sets[x]] = True
        if self.root.any >= 0:
            self._walk(x)
        self.held[self.sets[x]] = False

    def insert(self, x: int) -> None:
        node, left, path = self.root, self.sets[x], [self.root]
        while len(left):
            child = node.children.get(int(left[0]))
            if child is None:
                child = _Node(left)
                node.children[int(left[0])] = child
                node, left = child, left[:0]
                path.append(node)
                break
            m = min(len(child.items), len(left))
            apart = np.flatnonzero(child.items[:m] != left[:m])
            m = int(apart[0]) if len(apart) else m
            if m < len(child.items):  # split the child's part
                upper = _Node(child.items[:m])
                upper.any, upper.least, upper.same = child.any, child.least, child.same
                upper.rest = child.rest + len(child.items) - m
                child.items = child.items[m:]
                upper.children[int(child.items[0])] = child
                node.children[int(left[0])] = upper
                child = upper
            node, left = child, left[m:]
            path.append(node)
        node.sets.append(x)
        total = sum(len(p.items) for p in path)
        for p in path:
            total -= len(p.items)
            p.same = p.any < 0 or (p.same and self.find(p.any) == self.find(x))
            p.any = x if p.any < 0 else p.any
            p.least = min(p.least, self.sizes[x])
            p.rest = max(p.rest, total)

    def join(self) -> list[int]:
        for x in sorted(range(len(self.sets)), key=lambda i: self.sizes[i]):
            self.probe(x)
            self.insert(x)
        return [self.find(x) for x in range(len(self.sets))]


def _trie_links(grouped: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that connect each task's components, of ``grp, cls, n, token`` sorted by grp."""

    def make():
        def run(batches):
            a, b = [], []
            for _, rows in _groups(batches):
                if len(rows) < 2:
                    continue
                cls = [r[1] for r in rows]
                trie = Trie([np.frombuffer(r[3], "<u8") for r in rows], [r[2] for r in rows], percent)
                for x, root in enumerate(trie.join()):
                    if x != root:
                        a.append(cls[x])
                        b.append(cls[root])
                if len(a) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                    a, b = [], []
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return run

    return map_arrow(grouped, make, "a long, b long")


def join_components(docs: DataFrame, size: int = 5, percent: int = 80, least_frequent: int = 64, summary: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    ``summary`` bounds the very frequent shingles; none has ``least_frequent``
    occurrences or fewer. Neither changes the result.
    """
    spark = docs.sparkSession
    rows, parts = doc_bytes(docs), shuffle_partitions(spark)
    summary = summary or 16 * max(parts, 256)
    survey = materialize(_survey(rows, size, summary), "jaccard-survey")
    signed = survey.where("kind = 0").select("doc_id", "n", "cls")
    total = signed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    buckets = min(1 << 16, max(parts, -(-total // BUCKET_SHINGLES)))
    # Sums of mergeable summaries: at most ``summary`` shingles can reach this share.
    hot = survey.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") > max(least_frequent, total // summary)).select("cls")
    hot = np.sort(np.array([r.cls for r in hot.collect()], np.int64).view(np.uint64))

    shared = _shared_shingles(_deal(rows, size, buckets, hot), buckets)
    sets = materialize(_prefixes(shared, percent, buckets), "jaccard-sets")
    candidates = materialize(_candidate_edges(sets, parts), "jaccard-candidates")
    groups = connect(candidates, "jaccard-groups")  # v, root

    placed = sets.join(groups, sets.cls == groups.v).select(F.col("root").alias("grp"), "cls", "n", "token")
    large = groups.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > GROUP_SETS)
    large = [(r.root, r["size"]) for r in large.limit(100_000).collect()]
    small = placed
    pairs = None
    if large:
        # Blocks of a large group; every pair of blocks meets in one task.
        blocks = spark.createDataFrame([(g, -(-2 * s // GROUP_SETS)) for g, s in large], "grp long, blocks int")
        small = placed.join(F.broadcast(blocks.select("grp")), "grp", "left_anti")
        cut = placed.join(F.broadcast(blocks), "grp").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
        every = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = every.select(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "cls", "n", "token")
    whole = small if pairs is None else small.unionByName(pairs)
    found = materialize(_trie_links(whole.repartition(parts, "grp").sortWithinPartitions("grp"), percent), "jaccard-links")
    linked = connect(found, "jaccard-components")

    # One row for each class, so that a class that holds a third of all rows is one row here.
    by_class = signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    by_class = by_class.join(linked.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    roots = by_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = by_class.where(F.col("root").isNotNull()).join(roots, "root").select("cls", "component_id")
    out = signed.where("n > 0").join(named, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The row with the least ``doc_id`` of each component, in ``columns``.

    Rows are told apart by id and text, so rows that share an id are judged each; of
    equal rows one stays. A null id stays only where no row of its component has one.
    Rows without words are in no component and stay.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("_id"), row_hash().alias("_row")), "jaccard-rows")
    joined = join_components(docs.select(row_hash().alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).distinct()
    named = materialize(rows.join(joined, "_row"), "jaccard-named")
    first = named.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_row"))).alias("_first"))
    judged = named.join(first, "_group").select("_row", (F.col("_row") == F.col("_first._row")).cast("int").alias("_stays"))
    return without_rows(docs, judged, columns)
