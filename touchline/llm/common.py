"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a broadcast side may hold; larger sides go through a shuffle.
BROADCAST_BYTES = 8 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 2000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine has none, a folder of our own is set; on a
    cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "touchline-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/touchline/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; results that read it must be done."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what is above,
    and several readers share one computation. With ``tidy``, what was shuffled for it
    is deleted as soon as it is written.
    """
    path, conf = work_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized ``df`` that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if path.startswith(_own_dir(df.sparkSession)):
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(side: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Hint a broadcast only if ``rows * bytes_per_row`` is within the bound."""
    return F.broadcast(side) if rows * bytes_per_row <= BROADCAST_BYTES else side


def least_by_hash(df: DataFrame, h: Column, size: int, rows: int) -> DataFrame:
    """At most ``size`` of ``rows`` rows, those of least hash.

    Rows that cannot be among them are dropped where they lie, so that about
    ``size`` rows in all, not in each task, are sorted and sent.
    """
    part = F.pmod(h, F.lit(1 << 31))
    most = min(1 << 31, int((1 << 31) * (1.3 * size + 50) / max(rows, 1)))
    return df.withColumn("_part", part).where(F.col("_part") < most).orderBy("_part", h).limit(size).drop("_part")


def doc_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, body)`` with the text as UTF-8 bytes; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


def in_text_chunks(batches: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[tuple[list[int], list[bytes]]]:
    """Split ``(doc_id, body)`` batches into runs of documents of about ``limit`` bytes.

    A document is never cut; one that is longer makes a run of its own.
    """
    for batch in batches:
        bodies = batch.column(1)
        ids, texts, size = [], [], 0
        for doc, body in zip(batch.column(0).to_pylist(), bodies, strict=True):
            raw = body.as_py() or b""
            if texts and size + len(raw) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(raw)
            size += len(raw)
        if texts:
            yield ids, texts


def in_runs(batches: Iterator[pa.RecordBatch], limit: int, most: int = 60_000) -> Iterator[tuple[list, list[bytes]]]:
    """As ``in_text_chunks``, but runs go on over batches; none has more than ``most`` documents."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = body.as_py() or b""
            if texts and (size + len(raw) > limit or len(texts) == most):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield ids, texts


def joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Return freed memory of this Python worker to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, make: Callable[[], Callable], schema) -> DataFrame:
    """``mapInArrow`` with ``make()`` called once in each task.

    Rows of texts are large, so batches hold at most ``BATCH_ROWS`` rows unless the
    session says otherwise.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":  # Spark's default
        conf.set(_BATCH, BATCH_ROWS)

    def run(batches):
        try:
            yield from make()(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def row_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows of documents apart: a hash of the id and of the text's hash; equal rows share it."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))))


def without_rows(docs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` without the rows of which no copy stays, and once those of which one of several does.

    ``rows`` has ``_row`` (``row_hash``) and ``_stays`` (0 or 1) for rows of ``docs``;
    a row that is not in it stays.
    """
    judged = materialize(rows.groupBy("_row").agg(F.max("_stays").alias("_stays"), F.count("*").alias("_n")).where("_stays = 0 OR _n > 1"), "rows-judged")
    count = judged.groupBy("_stays").count().collect()
    count = {r["_stays"]: r["count"] for r in count}
    here = docs.withColumn("_row", row_hash())
    out = here.join(maybe_broadcast(judged.where("_stays = 0").select("_row"), count.get(0, 0), 16), "_row", "left_anti")
    if count.get(1):
        again = maybe_broadcast(judged.where("_stays = 1").select("_row"), count[1], 16)
        out = out.join(again, "_row", "left_anti").unionByName(out.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return out.select(*columns)


def in_fold(mod: int, fold: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's decimal text modulo ``mod`` is ``fold``; not so for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == fold, F.lit(False))
