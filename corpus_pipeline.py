"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``. Each is written as Parquet and read
again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import byte_bpe, exact_dedup, jaccard_join, langid, mixing
from touchline.llm.common import in_fold, without_rows, work_path
from touchline.llm.queries import mix_domain, mix_weight

#: Columns of ``documents``.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Corrected share of n-grams below which no learned language is taken for known.
LEAST_SHARE = 0.2
#: Share of the tokens that the mixture takes.
MIX_SHARE = 0.5


def _judged(text_hash: str):
    """The row that an operator names by id and the text's hash."""
    return F.xxhash64("doc_id", text_hash).alias("_row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a known language; ``und`` and texts like none of the languages go.

    Null texts and texts without a letter are ``und``. Repeated rows are judged alike.
    Without training rows nothing is known and everything goes.
    """
    filters = langid.train(docs.where(~in_fold(4, 2)))
    return langid.keep_known(docs, filters, LEAST_SHARE, COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of each group of equal texts that the operator keeps.

    Rows are told apart by id and text; of equal rows one stays, and a row with a null
    id stays only where its group has no other.
    """
    groups = exact_dedup.dedup_groups(docs)
    return without_rows(docs, groups.select(_judged("text_hash"), F.col("kept").cast("int").alias("_stays")), COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one of least id; texts without words stay."""
    return jaccard_join.one_of_each(docs, COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the target weights select, each once (one epoch).

    Texts without words have no tokens and go. Rows are told apart by id and text; of
    equal rows one stays at most.
    """
    mixed = mixing.mix_sources(docs, mix_domain(), mix_weight, lambda total: MIX_SHARE * total, epochs=1)
    return without_rows(docs, mixed.select(_judged("text_hash"), F.least("copies", F.lit(1)).alias("_stays")), COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document left."""
    import public_tokenizers

    out = byte_bpe.roundtrip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("mix_sources", mixture),
    ("byte_bpe", encoding),
]

#: No SQL expresses the language filters, the mixture's shortages or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
