"""Structured Streaming forms of the batch operators (ST-*, CDC-*)."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, time: str, kind: str, late: str = "1 day") -> DataFrame:
    """ST-03, ST-04: counts by day and kind; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def once_each(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """ST-01: rows with the same key within the watermark count once."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    """Settings that a query takes when it starts; the session has its own back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], state: str, mode: str = "append", conf: dict[str, str] | None = None) -> None:
    """Run a stream over what is there now, ``apply`` on every batch."""
    with _settings(stream.sparkSession, conf or {}):
        query = stream.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def run_available(stream: DataFrame, folder: str, mode: str = "complete", conf: dict[str, str] | None = None, numbered: bool = False) -> DataFrame:
    """Run a stream over what is there now and return its result, kept as Parquet in ``folder``.

    Every batch has a folder of its own, so that a repeated batch replaces itself.
    ``numbered`` adds its number as ``batch``.
    """
    written = []

    def keep(batch: DataFrame, number: int) -> None:
        (batch.withColumn("batch", F.lit(number).cast("long")) if numbered else batch).write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        written.append(f"{folder}/rows/{number}")

    run_batches(stream, keep, f"{folder}/state", mode, conf)
    spark = stream.sparkSession
    schema = stream.schema.add("batch", "long") if numbered else stream.schema
    return spark.read.schema(schema).parquet(*(written[-1:] if mode == "complete" else written)) if written else spark.createDataFrame([], schema)


#: Rows of a file that a task writes for ``in_cuts``.
FILE_ROWS = 500_000


def cut_stream(dealt: DataFrame, cut: str, numbers: list[int], path: str, end: DataFrame | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """A stream with one micro-batch for each of ``numbers``, the rows with that value of ``cut``, then ``end``.

    Every batch is written below ``path`` as the same number of files, so that a trigger
    takes a batch whole and no task writes or reads all of it. Empty files fill up a
    batch with fewer rows than files.
    """
    spark = dealt.sparkSession
    most = dealt.groupBy(cut).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    files = max(1, -(-most // file_rows))
    batches = [dealt.where(F.col(cut) == k).drop(cut) for k in numbers]
    if end is not None:
        batches.append(end.select(*batches[0].columns))
    for k, batch in enumerate(batches):
        place = f"{path}/batch={k}"
        (batch.repartition(files) if files > 1 else batch.coalesce(1)).write.mode("overwrite").parquet(place)
        for _ in range(files - len(spark.read.schema(batch.schema).parquet(place).inputFiles())):
            batch.limit(0).coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", files).parquet(f"{path}/batch=*")


def in_cuts(df: DataFrame, path: str, cuts: int, order: str | None = None, end: DataFrame | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """A stream of ``df``'s rows in ``cuts`` micro-batches, dealt by hash (or in ``order``), then ``end``.

    The rows are written below ``path``, one folder for each batch.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(cuts)) if order is None else F.ntile(cuts).over(Window.orderBy(order)) - 1
    return cut_stream(df.withColumn("_cut", part), "_cut", list(range(cuts)), path, end, file_rows)


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, or of a single file; the schema is that of the files."""
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    files = batch.inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(path.split("://")[-1].rstrip("/")):
        folder, _, name = path.rstrip("/").rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)
