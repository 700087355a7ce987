"""Exact dedup: 128-bit content hash, smallest stable id, bytes compared in groups.

DataFrame functions only. Two texts are equal when they are the same after every
character of ``[\\x20\\x09-\\x0D]`` is deleted; a null text counts as empty, and
all empty texts form one group.

1. Every row is reduced to its id, length and digests (no shuffle of texts).
2. Rows are grouped by the 128-bit hash. The aggregation combines on the map
   side, so a group that holds a third of all rows sends one row per task.
3. Texts of hashes with two or more rows are compared byte by byte: they are
   grouped by (hash, text) itself, again combined on the map side, so copies
   collapse before the exchange. A hash under which two different texts are
   found is a collision, and its rows are grouped by text instead.

Extra columns are ignored. Rows that share a ``doc_id`` count as rows of their
own, and of equal rows exactly one is kept; a null id loses every tie. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast

#: Deleted before texts are compared (fixed value).
SPACES = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def content_hash(norm: Column) -> Column:
    """128 bits as 16 bytes."""
    return F.unhex(F.md5(norm.cast("binary")))


def _best() -> Column:
    """Most code points first, then the smallest id."""
    return F.max(F.struct(F.col("n_points"), (-F.col("doc_id")).alias("neg_id"), (-F.col("row")).alias("neg_row")))


def dedup_groups(docs: DataFrame, hasher: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, text_hash``, one row for each row of ``docs``.

    ``text_hash`` is xxhash64 of the text as it is, so that ``(doc_id, text_hash)`` tells rows apart.

    ``hasher`` maps the normalised text to the grouping hash; a weak one gives
    the same result with more byte comparisons.
    """
    norm, text_hash = normalized(F.col("text")), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce(F.col("text"), F.lit(""))).alias("n_points"), norm.alias("norm"), text_hash).select(
            "doc_id", "n_points", F.sha2(F.col("norm"), 256).alias("text_sha256"), hasher(F.col("norm")).alias("h"), "text_hash", F.monotonically_increasing_id().alias("row")
        ),
        "dedup-rows",
    )
    groups = materialize(rows.groupBy("h").agg(F.count("*").alias("group_size"), _best().alias("best")), "dedup-groups")
    shared = groups.where("group_size > 1").select("h")
    n_shared = shared.count()

    # Bytes inside groups: one row for each different text under a shared hash.
    texts = docs.select(norm.alias("norm")).withColumn("h", hasher(F.col("norm"))).join(maybe_broadcast(shared, n_shared, 32), "h", "left_semi")
    split = texts.groupBy("h", "norm").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("n_texts")).where("n_texts > 1").select("h")
    split = materialize(split, "dedup-collisions")

    if split.isEmpty():
        out = rows.join(groups, "h")
    else:
        collided = (
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce(F.col("text"), F.lit(""))).alias("n_points"), norm.alias("norm"), text_hash)
            .withColumn("h", hasher(F.col("norm")))
            .join(split, "h", "left_semi")
        )
        collided = materialize(collided.withColumn("row", F.monotonically_increasing_id()), "dedup-collided")
        by_text = collided.groupBy("h", "norm").agg(F.count("*").alias("group_size"), _best().alias("best"))
        apart = collided.select("doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), "h", "text_hash", "row", "norm").join(by_text, ["h", "norm"]).drop("norm")
        out = rows.join(split, "h", "left_anti").join(groups, "h").unionByName(apart)
    keep = (-F.col("best.neg_id")).alias("keep_id")
    return out.select("doc_id", keep, F.col("group_size").cast("long").alias("group_size"), (F.col("row") == -F.col("best.neg_row")).alias("kept"), "text_sha256", "text_hash")
