"""Sinks (W-21 to W-28)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str], by: list[str] | None = None) -> None:
    """W-21, W-22: fixed columns, missing values empty, quotes doubled; one folder for each value of ``by``."""
    out = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))
    writer = out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_audit(df: DataFrame, path: str) -> None:
    """W-23: JSON lines, nulls kept, added to what is there."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def archive(pages: DataFrame, known: DataFrame, html: str, at: str) -> DataFrame:
    """W-24: pages whose content is not archived yet, each content once, with hash and path."""
    from .scans import archive_key

    keyed = pages.withColumn("sha256", F.sha2(html, 256)).withColumn("path", archive_key(F.col(html), F.col(at)))
    return keyed.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")


def replace_table(df: DataFrame, path: str) -> None:
    """W-27."""
    df.write.mode("overwrite").parquet(path)


def run_outcome(df: DataFrame) -> DataFrame:
    """W-28: status of a run by what it did and its failure."""
    failed, made = F.col("failure_kind").isNotNull(), (F.col("records_created") + F.col("records_updated")) > 0
    status = F.when(F.col("completed_at").isNull(), "running").when(failed & ~made, "failed").when(failed | (F.col("records_failed") > 0), "partial").otherwise("ok")
    return df.withColumn("status", status)
