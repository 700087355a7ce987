"""WARC archives: writing, reading, and assembly of captures from their records.

Writing. Every page gives three records: a request, the response (or, where an
equal payload has one already, a revisit that refers to it), and metadata; the
first and last name the second in ``WARC-Concurrent-To``. Of rows with equal
payloads, that of smallest ``page_id`` is the response. Tasks stream records, each
a gzip member of its own, into files of about ``FILE_BYTES`` in the shared folder;
the returned manifest names the files that count, so what a lost task left behind
is never read. Equal payloads are found by SHA-256 (map-side combined); only rows
of payloads that occur twice meet in a join, in which Spark can split a hot one.

Reading. A task streams a file record by record; payload length and SHA-1 are
those of the payload read, and ``intact`` says whether the record's own digest
agrees.

Assembly. Records are joined through concurrent-to identifiers, in either
direction: first those that touch a response, revisit or resource directly, then,
round by round, those that touch one of these. One nested row comes out for each
capture. Records without a way to one form captures without a response.

Results in odd cases. A null html is the empty payload, and empty payloads are
equal. A null ``page_id`` loses every tie and comes back null; of repeated rows one
is the response and the others revisit it. A null url leaves out the target;
characters that a header cannot hold are percent-encoded. A record that answers
two captures belongs to the one of smaller identifier. An empty table gives an
empty result and no file. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_arrow, materialize, maybe_broadcast, shuffle_partitions, work_path
from .components import connect

#: Bytes after which a task begins another file.
FILE_BYTES = 64 << 20
#: Of zlib; a page is compressed on its own.
LEVEL = 3
#: Names of the format (fixed values).
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Kinds of record that a capture is built around.
ANCHORS = ("response", "revisit", "resource")
_RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("captured_at", pa.string()),
    ("payload_digest", pa.string()), ("intact", pa.bool_()), ("payload_bytes", pa.int64()), ("http_head", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])
_RECORD_SQL = (
    "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, captured_at string, "
    "payload_digest string, intact boolean, payload_bytes long, http_head string, fields map<string,string>, payload binary"
)


def first_of_equal(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, body, row, key, first_id, first_row`` (null for the first itself and for payloads below ``least_bytes``)."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "warc-rows")
    best = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    equal = rows.where(F.octet_length("body") >= least_bytes).groupBy("key").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1")
    equal = materialize(equal.select("key", F.col("best.page_id").alias("first_id"), F.col("best.row").alias("first_row")), "warc-equal")
    joined = rows.join(maybe_broadcast(equal, equal.count(), 120), "key", "left")
    again = F.col("first_row") != F.col("row")
    return joined.select("page_id", "url", "body", "row", F.when(again, F.col("first_id")).alias("first_id"), F.when(again, F.col("first_row")).alias("first_row"))


def _clean(value: str) -> str:
    """A header value without control characters."""
    return "".join(c if " " <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(kind: str, record_id: str, block: bytes, content_type: str, date: str, more: list[tuple[str, str]]) -> bytes:
    """One record as bytes."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *more, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"".join([VERSION.encode(), b"\r\n", *(f"{k}: {_clean(v)}\r\n".encode() for k, v in head), b"\r\n", block, b"\r\n\r\n"])


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_records(name: str, page_id: int | None, url: str | None, body: bytes, row: int, first_id: int | None, first_row: int | None, date: str) -> Iterator[bytes]:
    """Request, response or revisit, and metadata of one page of the crawl ``name``."""
    known = lambda kind, n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{name}/{n}/{kind}')}>"
    target = [] if url is None else [("WARC-Target-URI", url)]
    own = known("response", row)
    rest = _clean(url or "").partition("://")[2]
    host, _, path = rest.partition("/")
    ask = f"GET /{path.partition('#')[0].replace(' ', '%20')} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    yield record("request", known("request", row), ask, "application/http; msgtype=request", date, [*target, ("WARC-Concurrent-To", own)])
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    digest = ("WARC-Payload-Digest", _digest(body))
    if first_row is None:
        yield record("response", own, head + body, "application/http; msgtype=response", date, [*target, digest])
    else:
        yield record("revisit", own, head, "application/http; msgtype=response", date, [*target, digest, ("WARC-Profile", PROFILE), ("WARC-Refers-To", known("response", first_row))])
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id),) if v is not None)
    yield record("metadata", known("metadata", row), fields.encode(), "application/warc-fields", date, [*target, ("WARC-Concurrent-To", own)])


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives of ``page_id, url, html``; the manifest ``path, n_records, n_bytes``.

    Payloads of fewer than ``least_bytes`` are responses each.
    """
    spark = pages.sparkSession
    folder = folder or work_path(spark, "warc")
    name = folder.rsplit("/", 1)[-1]

    def make():
        from pyarrow import fs

        def run(batches):
            rows = (row for batch in batches for row in zip(*(batch.column(k) for k in range(6)), strict=True))
            waiting = next(rows, None)
            system, at = fs.FileSystem.from_uri(folder)
            if waiting is not None:
                system.create_dir(at, recursive=True)
            while waiting is not None:
                file_name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with system.open_output_stream(f"{at}/{file_name}", compression=None) as file:
                    info = _member(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"format: WARC File Format 1.1\r\n", "application/warc-fields", date, [("WARC-Filename", file_name)]))
                    file.write(info)
                    size += len(info)
                    while waiting is not None and size < file_bytes:
                        for raw in capture_records(name, *(v.as_py() for v in waiting), date):
                            member = _member(raw)
                            file.write(member)
                            size += len(member)
                            n += 1
                        waiting = next(rows, None)
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{file_name}"], "n_records": [n], "n_bytes": [size]})

        return run

    rows = first_of_equal(pages, least_bytes).select("page_id", "url", "body", "row", "first_id", "first_row")
    manifest = materialize(map_arrow(rows, make, "path string, n_records long, n_bytes long"), "warc-manifest")
    forget(rows)
    return manifest


def _fields(block: bytes) -> list[tuple[str, str]]:
    """``name: value`` lines; a line that begins with a space goes on with the value before."""
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            key, _, value = line.partition(":")
            out.append((key.strip(), value.strip()))
    return out


def records(stream, path: str = "") -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """``(headers, block)`` of each record of an archive, plain or gzip, one at a time."""
    buffered = io.BufferedReader(stream, 1 << 20)
    if buffered.peek(2)[:2] == b"\x1f\x8b":
        buffered = io.BufferedReader(gzip.GzipFile(fileobj=buffered), 1 << 20)
    while line := buffered.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: not a record of an archive: {line[:40]!r}")
        head = []
        while (line := buffered.readline()).strip():
            head.append(line)
        fields = _fields(b"".join(head))
        size = int({k.lower(): v for k, v in fields}.get("content-length", "0"))
        block = buffered.read(size)
        if len(block) < size:
            raise ValueError(f"{path}: a record is cut off")
        yield fields, block


def parsed(headers: list[tuple[str, str]], block: bytes, payloads: bool) -> tuple:
    """A record as a row of ``_RECORD``."""
    one = {k.lower(): v for k, v in reversed(headers)}
    kind, content = one.get("warc-type", ""), one.get("content-type", "")
    http_head, payload, fields = None, block, None
    if content.startswith("application/http"):
        head, gap, rest = block.partition(b"\r\n\r\n")
        http_head, payload = head.decode("utf-8", "replace"), rest if gap else b""
    if content.startswith("application/warc-fields"):
        fields = list(dict(_fields(block)).items())
    stored = one.get("warc-payload-digest")
    read = None if kind == "revisit" else _digest(payload)
    digest = (stored or read).removeprefix("sha1:") if stored or read else None
    intact = None if kind == "revisit" or stored is None or not stored.startswith("sha1:") else stored == read
    together = [v for k, v in headers if k.lower() == "warc-concurrent-to"]
    n = None if kind == "revisit" else len(payload)
    return one.get("warc-record-id"), kind, together, one.get("warc-refers-to"), one.get("warc-target-uri"), one.get("warc-date"), digest, intact, n, http_head, fields, payload if payloads and kind in ANCHORS else None


def read_records(spark: SparkSession, files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named by ``path``; without ``payloads`` that column is null."""
    parts = max(1, min(4 * shuffle_partitions(spark), files.count()))
    paths = files.select("path").repartition(parts, "path")

    def make():
        from pyarrow import fs

        def run(batches):
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    system, at = fs.FileSystem.from_uri(path)
                    held, size = [], 0
                    with system.open_input_stream(at, compression=None) as file:
                        for headers, block in records(file, path):
                            row = parsed(headers, block, payloads)
                            held.append(row)
                            size += 500 + len(row[-1] or b"")
                            if size > 4 << 20:
                                yield _batch(held)
                                held, size = [], 0
                    if held:
                        yield _batch(held)

        return run

    return map_arrow(paths, make, _RECORD_SQL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)


def capture_of(heads: DataFrame) -> DataFrame:
    """``record_id, capture`` of every record but anchors: the capture that its concurrent-to links lead to."""
    links = heads.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    anchors = heads.where(F.col("record_type").isin(*ANCHORS)).select(F.col("record_id").alias("b"))
    others = heads.where(~F.col("record_type").isin(*ANCHORS)).select("record_id")
    direct = links.join(anchors, "b", "left_semi").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).join(anchors, "b", "left_semi"))
    found = materialize(direct.groupBy(F.col("a").alias("record_id")).agg(F.min("b").alias("capture")), "warc-direct")
    left = materialize(others.join(found, "record_id", "left_anti"), "warc-left")
    fresh, rounds = found, [found]
    while not left.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(left.withColumnRenamed("record_id", "a"), "a", "left_semi")
        more = both.join(fresh.select(F.col("record_id").alias("b"), "capture"), "b").groupBy(F.col("a").alias("record_id")).agg(F.min("capture").alias("capture"))
        fresh = materialize(more, "warc-round")
        if fresh.isEmpty():  # no way to a capture: records that are concurrent to one another stay together
            alone = connect(both, "warc-alone").select(F.col("v").alias("record_id"), F.col("root").alias("capture"))
            rounds.append(left.join(alone, "record_id", "left").select("record_id", F.coalesce("capture", "record_id").alias("capture")))
            break
        rounds.append(fresh)
        left = materialize(left.join(fresh, "record_id", "left_anti"), "warc-left")
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.join(others, "record_id", "left_semi")


def captures(read: DataFrame) -> DataFrame:
    """One nested row for each capture of records without payloads.

    ``capture, record_type, target_uri, captured_at, page_id, payload_bytes, payload_digest,
    intact, original`` (of a revisit: capture and page_id of what it refers to),
    ``response``, ``requests``, ``metadata``. A capture has few records beside its
    response; these, never payloads, are gathered. Length and digest of a revisit are
    those of the payload it refers to.
    """
    heads = materialize(read.where(F.col("record_type") != "warcinfo").drop("payload"), "warc-heads")
    anchors = heads.where(F.col("record_type").isin(*ANCHORS))
    of = capture_of(heads).join(heads, "record_id")
    entry = F.struct("record_id", "target_uri", "captured_at", "http_head", "fields")
    beside = of.groupBy("capture").agg(
        F.array_sort(F.collect_list(F.when(F.col("record_type") == "request", F.struct("record_id", "target_uri", "captured_at", "http_head")))).alias("requests"),
        F.collect_list(F.when(F.col("record_type") == "metadata", entry)).alias("metadata"),
    )
    response = F.when(F.col("record_type").isNotNull(), F.struct("record_id", "http_head", "payload_digest", "payload_bytes"))
    joined = anchors.select(F.col("record_id").alias("capture"), "record_type", "refers_to", "target_uri", "captured_at", "payload_digest", "payload_bytes", "intact", response.alias("response")).join(beside, "capture", "full")
    pages = F.filter(F.transform("metadata", lambda m: m["fields"]["page-id"].try_cast("long")), lambda p: p.isNotNull())
    joined = materialize(joined.withColumn("page_id", F.try_element_at(pages, F.lit(1))), "warc-captures")
    referred = joined.where("record_type <> 'revisit'").select(F.col("capture").alias("refers_to"), F.struct("capture", "page_id", "payload_bytes", "payload_digest").alias("original"))
    asked = materialize(joined.where("refers_to IS NOT NULL").groupBy("refers_to").count().select("refers_to"), "warc-asked")
    n = asked.count()
    referred = maybe_broadcast(referred.join(maybe_broadcast(asked, n, 64), "refers_to", "left_semi"), n, 250)
    out = joined.join(referred, "refers_to", "left")
    return out.select(
        "capture", "record_type", "target_uri", "captured_at", "page_id",
        F.coalesce("original.payload_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("original.payload_digest", "payload_digest").alias("payload_digest"),
        "intact", "original", "response", *(F.coalesce(c, F.array().cast(beside.schema[c].dataType)).alias(c) for c in ("requests", "metadata")),
    )


def with_payloads(assembled: DataFrame, spark: SparkSession, files: DataFrame) -> DataFrame:
    """``captures`` with the payload of each response, or of what a revisit refers to."""
    bodies = read_records(spark, files).where("payload IS NOT NULL AND record_type <> 'revisit'").select(F.col("record_id").alias("_from"), "payload")
    return assembled.withColumn("_from", F.coalesce("original.capture", "capture")).join(bodies, "_from", "left").drop("_from")
