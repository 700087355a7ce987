"""Token-id output: compressed shards of documents' ids, in ascending id order.

A store is a folder in shared storage:

``dictionary``
    A zstandard dictionary, trained on the serialised id arrays of at most
    ``SAMPLE_DOCS`` documents (those of least hash of the id; of each a window of at
    most ``SAMPLE_BYTES`` of text that may begin anywhere). Only the dictionary is fitted to that sample.
``<shard>-<part>-<token>.ids``
    ``MAGIC``, SHA-256 of the dictionary (32 bytes) and bytes of an id (2 or 4,
    unsigned 64-bit), then one zstandard frame for each document, the index (for each
    document its id (int64), whether the id is not null (uint64), the offset of its
    frame in the file, the size of the frame and the number of ids (uint64)), and
    last the number of documents (unsigned 64-bit). All numbers are little-endian.

Texts are sorted by range of ``doc_id`` and every task writes its range as files of
about ``SHARD_BYTES`` under names of their own, frame by frame. Only the names in the manifest that the tasks
return count, so that files of lost attempts do no harm.

A null text counts as empty and has the end id alone. Special tokens of the tokenizer
that stand in a text are read as the library reads them. A null ``doc_id`` sorts
first; rows with the same id are ordered by text. Texts are encoded whole, extra
columns are ignored, and an empty table gives a store without documents.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_bytes, in_text_chunks, least_by_hash, map_arrow, materialize, shuffle_partitions, work_path

MAGIC = b"TLIDS002"
HEADER = len(MAGIC) + 32 + 8
#: Compressed bytes from which a new file is begun.
SHARD_BYTES = 64 << 20
INDEX = np.dtype([("doc_id", "<i8"), ("valid", "<u8"), ("offset", "<u8"), ("size", "<u8"), ("n", "<u8")])
SAMPLE_DOCS = 512
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: Text that is encoded at a time.
RUN_BYTES = 4_000_000
#: Entries of each table of pieces that a worker remembers.
REMEMBERED = 1_000_000

#: White space other than blanks and line feeds, or what may be some, in UTF-8.
_SPACES = [b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80"]
_ODD = re.compile(r"[\x1c-\x1f]")
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Marks that may follow a word; none begins a contraction.
_MARKS = ".,!?;:#$%&*|\"()+=/-"
#: Letters before this one are letters to both pattern dialects.
_LATIN = "\u0250"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered:
    """A bounded table in two generations: what is used again stays."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size // 2, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys that are not known; the known ones are in ``young`` afterwards."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        out = []
        for key in keys - self.young.keys():
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                self.young[key] = value
        return out


class Encoder:
    """Ids of texts from the ``tokenizers`` library, which sees each piece of text once.

    The tokenizer's own pattern never joins what stands before a blank with what
    follows the blank's first character, so texts may be cut there and the chunks
    encoded alone. In a chunk of Latin letters with marks behind them the word and
    the marks are matches of their own; the word goes straight to the library's
    model. Texts with control characters that the two pattern dialects class
    differently are encoded in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts that hold an added token are encoded in one piece.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.raw = [i.to_bytes(4, "little") for i in range(self.vocabulary())]
        self.spaced = Remembered(REMEMBERED)  # by the chunk without its leading blank
        self.plain = Remembered(REMEMBERED)
        self.marks: dict[str, bytes] = {}

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, before: str) -> bytes:
        letters = before + word
        if not word.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letters)
        elif before:
            letters = self.letters[32] + word  # ASCII letters stand for themselves
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(letters)])

    def _learn(self, table: Remembered, chunks: set[str], before: str) -> dict[str, bytes]:
        new, other = table.missing(chunks), []
        young, old, marks = table.young, table.old, self.marks
        for c in new:
            word = c.rstrip(_MARKS)
            if not word.isalpha() or not (word.isascii() or max(word) < _LATIN):
                other.append(c)
                continue
            ids = young.get(word) or old.get(word)
            if ids is None:
                ids = young[word] = self._word(word, before)
            if len(word) < len(c):
                mark = c[len(word) :]
                if mark not in marks:
                    if len(marks) > REMEMBERED:
                        marks.clear()
                    marks[mark] = self.direct([mark])[0]
                young[c] = ids + marks[mark]
            else:
                young[c] = ids
        if other:
            young.update(zip(other, self.direct([before + c for c in other]), strict=True))
        return young

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8) as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        spaced, plain = [], []
        for i, data in enumerate(texts):
            text = data.decode("utf-8", "replace")
            if not text:
                out[i] = b""
                continue
            if any(token in data for token in self.added):
                out[i] = self.direct([text])[0]
                continue
            if not any(space in data for space in _SPACES):
                chunks = text.replace("\n", " \n").split(" ")
                if "" not in chunks and "\n" not in chunks:  # no white space meets another one or an end
                    spaced.append((i, chunks[0], chunks[1:]))
                    continue
            if _ODD.search(text):
                out[i] = self.direct([text])[0]
            else:
                plain.append((i, _CHUNK.findall(text)))
        whole = {first for _, first, _ in spaced}.union(*(c for _, c in plain))
        after = set().union(*(rest for _, _, rest in spaced))
        lines = {c for c in after if c[0] == "\n"}  # chunks behind a line feed have no blank
        own = self._learn(self.plain, whole | lines, "")
        table = self._learn(self.spaced, after - lines, " ")
        table.update((c, own[c]) for c in lines)
        for i, first, rest in spaced:
            out[i] = own[first] + b"".join([table[c] for c in rest])
        for i, chunks in plain:
            out[i] = b"".join([own[c] for c in chunks])
        return out

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _read(folder: str, name: str) -> bytes:
    system, path = _files(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as file:
        return file.read()


def _write(folder: str, name: str, parts) -> int:
    system, path = _files(folder)
    system.create_dir(path, recursive=True)
    size = 0
    with system.open_output_stream(f"{path}/{name}", compression=None) as file:
        for part in parts:
            file.write(part)
            size += len(part)
    return size


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from the serialised ids of the sample; raw content where there is too little to train on."""
    import zstandard

    room = F.greatest(F.octet_length("body") - SAMPLE_BYTES + 1, F.lit(1))
    rows = docs.select("doc_id", F.substring("body", (F.pmod(F.xxhash64(F.lit(3), "doc_id"), room) + 1).cast("int"), F.lit(SAMPLE_BYTES)).alias("body"))
    sample = least_by_hash(rows, F.xxhash64("doc_id"), SAMPLE_DOCS, docs.count()).collect()
    encoder = _encoder(path)
    kind = "<u2" if encoder.vocabulary() <= 1 << 16 else "<u4"
    coded = [np.append(np.frombuffer(ids, "<u4"), end_id).astype(kind).tobytes() for ids in encoder.encode([bytes(r.body) for r in sample])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, coded).as_bytes()
    except zstandard.ZstdError:
        return b"".join(coded)[:DICTIONARY_BYTES]


def write_store(docs: DataFrame, path: str, end_id: int, folder: str, file_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the store; the manifest ``shard, name, first_id, last_id, n_docs, n_ids, n_bytes``."""
    spark = docs.sparkSession
    rows = doc_bytes(docs)
    raw = train_dictionary(rows, path, end_id)
    _write(folder, "dictionary", [raw])
    shared = spark.sparkContext.broadcast(raw)  # DICTIONARY_BYTES at most
    ranges = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "body")

    def make():
        import zstandard
        from pyspark import TaskContext

        encoder = _encoder(path)
        kind, width = ("<u2", 2) if encoder.vocabulary() <= 1 << 16 else ("<u4", 4)
        trained = _dictionary(shared.value)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained) if trained else zstandard.ZstdCompressor(level=LEVEL)

        def run(batches):
            def frames():
                for ids, texts in in_text_chunks(batches, RUN_BYTES):
                    for doc, coded in zip(ids, encoder.encode(texts), strict=True):
                        array = np.append(np.frombuffer(coded, "<u4"), np.uint32(end_id))
                        yield doc, len(array), squeeze.compress(array.astype(kind).tobytes())

            def file(first):
                """The parts of one file: from ``first`` until it is large enough; fills ``index``."""
                at = HEADER
                yield MAGIC + hashlib.sha256(shared.value).digest() + np.array([width], "<u8").tobytes()
                for doc, n, frame in itertools.chain([first], left):
                    index.append((doc or 0, doc is not None, at, len(frame), n))
                    at += len(frame)
                    yield frame
                    if at > file_bytes:
                        break
                yield np.array(index, INDEX).tobytes()
                yield np.array([len(index)], "<u8").tobytes()

            left, number = frames(), TaskContext.get().partitionId()
            for part, first in enumerate(left):
                index = []
                name = f"{number:07d}-{part:05d}-{uuid.uuid4().hex}.ids"
                size = _write(folder, name, file(first))
                yield pa.RecordBatch.from_pydict(
                    {"shard": [number << 20 | part], "name": [name], "first_id": [index[0][0]], "last_id": [index[-1][0]], "n_docs": [len(index)], "n_ids": [sum(x[4] for x in index)], "n_bytes": [size]}
                )

        return run

    return materialize(map_arrow(ranges, make, "shard long, name string, first_id long, last_id long, n_docs long, n_ids long, n_bytes long"), "ids-manifest")


def _check(folder: str, data: bytes) -> None:
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard of token ids")
    if data[len(MAGIC) : len(MAGIC) + 32] != hashlib.sha256(_read(folder, "dictionary")).digest():
        raise ValueError("the shard was written with another dictionary")


def read_store(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of all documents, from the files; ``start`` counts the ids before."""
    shards = sorted(manifest.select("shard", "name", "n_ids").collect())  # one row for each file
    before, rows = 0, []
    for k, shard in enumerate(shards):
        rows.append((k, shard.name, before))
        before += shard.n_ids
    table = spark.createDataFrame(rows, "k int, name string, before long").repartitionById(max(1, len(rows)), "k")

    def make():
        import zstandard

        def run(batches):
            for batch in batches:
                for name, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    data = _read(folder, name)
                    _check(folder, data)
                    trained = _dictionary(_read(folder, "dictionary"))
                    open_ = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
                    width, n = np.frombuffer(data, "<u8", 1, HEADER - 8)[0], np.frombuffer(data, "<u8", 1, len(data) - 8)[0]
                    index = np.frombuffer(data, INDEX, int(n), len(data) - 8 - int(n) * INDEX.itemsize)
                    starts = first + np.cumsum(index["n"]).astype(np.int64) - index["n"].astype(np.int64)
                    for at in range(0, int(n), 500):
                        part = index[at : at + 500]
                        ids = [np.frombuffer(open_.decompress(data[o : o + s]), f"<u{width}").astype("<u4").tobytes() for o, s in zip(part["offset"].tolist(), part["size"].tolist(), strict=True)]
                        docs = pa.array(part["doc_id"].astype(np.int64), mask=part["valid"] == 0)
                        yield pa.RecordBatch.from_arrays([docs, pa.array(starts[at : at + 500]), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

        return run

    return map_arrow(table, make, "doc_id long, start long, ids binary")


def read_document(folder: str, manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents with one id, by the index: only their frames are read."""
    import zstandard
    from pyarrow import fs

    out = []
    trained = _dictionary(_read(folder, "dictionary"))
    open_ = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    for row in manifest.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("shard").collect():
        system, path = fs.FileSystem.from_uri(f"{folder}/{row.name}")
        with system.open_input_file(path) as file:
            width, n = np.frombuffer(file.read_at(8, HEADER - 8), "<u8")[0], np.frombuffer(file.read_at(8, row.n_bytes - 8), "<u8")[0]
            size = int(n) * INDEX.itemsize
            index = np.frombuffer(file.read_at(size, row.n_bytes - 8 - size), INDEX)
            for entry in index[(index["doc_id"] == doc_id) & (index["valid"] == 1)]:
                out.append(np.frombuffer(open_.decompress(file.read_at(int(entry["size"]), int(entry["offset"]))), f"<u{width}").astype(np.uint32))
    return out


def new_folder(spark: SparkSession) -> str:
    return work_path(spark, "token-store")
