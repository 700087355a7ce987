"""The queries of the training-data operators and their SQL.

Each ``opN_<name>`` applies its operator with production parameters to its whole
table. Modules are imported when a query is first asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_model import score

    out = score(documents(spark, sf_dir), ~in_fold(5, 1))
    return out.select("doc_id", in_fold(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup_groups

    return dedup_groups(documents(spark, sf_dir)).drop("text_hash")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join_components

    return join_components(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import tag, train

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.where(~in_fold(4, 2)), labels.where(~in_fold(4, 2)))
    return tag(docs, model).select("doc_id", in_fold(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import new_folder, read_store, write_store

    folder = new_folder(spark)
    manifest = write_store(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 0, folder)
    return read_store(spark, folder, manifest).select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import roundtrip

    out = roundtrip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict, train

    docs = documents(spark, sf_dir)
    filters = train(docs.where(~in_fold(4, 2)))
    return predict(docs, filters).select("doc_id", in_fold(4, 2).alias("held_out"), "lang_pred", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    found = scan(documents(spark, sf_dir))
    labels = lambda *parts: F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.col("base.label"), F.col("notices.label")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.similarity"), F.lit(0.0))).alias("score"),
    )


def op9_chroma_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chroma import match, recordings

    return match(recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).withColumnRenamed("rec_id", "vec_id")


#: Target weights (production parameters): by domain, language and source.
DOMAIN_WEIGHT = {"0": 4.0, "1": 3.0, "2": 2.0, "3": 1.0}
LANG_WEIGHT = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}


def mix_weight(path: tuple) -> float:
    if len(path) == 1:
        return DOMAIN_WEIGHT.get(path[0], 1.0)
    return LANG_WEIGHT.get(path[1], 1.0) if len(path) == 2 else 1.0


def mix_domain():
    """A source's domain: the number at the end of its name modulo 4."""
    return (F.regexp_extract("source", r"([0-9]{1,9})$", 1).try_cast("int") % 4).cast("string")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    out = mix_sources(documents(spark, sf_dir), mix_domain(), mix_weight, lambda total: total // 2, epochs=2)
    return out.drop("text_hash")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import captures, read_records, write_archives

    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = captures(read_records(spark, files, payloads=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("original.page_id").alias("refers_to"))


#: Most turns that ``op12_conv_trie`` takes from another conversation, plus one (fixed value).
HEADS = 9


def op12_conv_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import rebuilt, trie, turns_of

    turns = turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    return trie(rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 5, head, HEADS - 1))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress, digest

    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_lm_score": op3_lm_score,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_store": op5_token_store,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_chroma_match": op9_chroma_match,
    "op10_mix_sources": op10_mix_sources,
    "op11_warc": op11_warc,
    "op12_conv_trie": op12_conv_trie,
    "op13_vector_codes": op13_vector_codes,
}


def _codes_sql() -> str:
    """The two rounds of ``op13_vector_codes``, unrolled."""
    steps = ["""
        v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS ints FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT row_number() OVER () AS r, vec_id, label, unnest(range(16)) AS part, ints, len(ints) // 16 AS k FROM v),
        x AS (SELECT r, vec_id, label, part, ints[part * k + 1 : part * k + k] AS xs FROM p),
        b0 AS (SELECT part, entry, xs FROM (SELECT part, xs, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry FROM x) WHERE entry < 64)"""]
    near = """
        {a} AS (SELECT r, vec_id, label, part, xs, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
                SELECT x.*, b.entry, list_sum(list_transform(range(1, len(x.xs) + 1), lambda i: (x.xs[i] - b.xs[i]) * (x.xs[i] - b.xs[i])))::BIGINT AS d
                FROM x JOIN {b} b USING (part)) GROUP BY ALL)"""
    for n in (1, 2):
        steps.append(near.format(a=f"a{n}", b=f"b{n - 1}"))
        steps.append(f"""
        b{n} AS (SELECT o.part, o.entry, coalesce(m.xs, o.xs) AS xs FROM b{n - 1} o LEFT JOIN (
                SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS xs FROM (
                    SELECT part, entry, i, sum(xs[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, xs, unnest(range(1, len(xs) + 1)) AS i FROM a{n}) GROUP BY ALL)
                GROUP BY ALL) m ON m.part = o.part AND m.entry = o.entry)""")
    steps.append(near.format(a="a3", b="b2"))
    return "WITH " + ",".join(steps) + """,
        c AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(xs, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
        FROM c"""


ORACLE_SQL = {
    "op4_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        k AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
    """,
    "op11_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first_id FROM p WINDOW w AS (PARTITION BY body ORDER BY page_id NULLS LAST))
        SELECT page_id, strlen(body) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * (i // 4))::INTEGER + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to
        FROM r
    """,
    "op12_conv_trie": """
        WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
                          {'r': coalesce(role, ''), 't': coalesce(text, '')} AS v FROM conversations WHERE conv_id IS NOT NULL),
        h AS (SELECT c, list_reduce(list_transform(str_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda crc, b:
                  list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)), 4294967295) AS crc
              FROM (SELECT DISTINCT c FROM t)),
        conv AS (SELECT c, (xor(crc, 4294967295) % 9)::BIGINT AS h FROM h),
        own AS (SELECT c, list(v ORDER BY k) AS vs FROM t GROUP BY c),
        re AS (SELECT conv.c, list_concat(coalesce(base.vs[1:h], []), own.vs[h + 1:]) AS vs
               FROM conv JOIN own USING (c) LEFT JOIN own base ON base.c = conv.c - conv.c % 5),
        p AS (SELECT c, len(vs) AS n, d, md5(to_json(vs[1:d])::VARCHAR) AS node, md5(to_json(vs[1:d - 1])::VARCHAR) AS up, coalesce(strlen(vs[d].t), 0) AS bytes
              FROM (SELECT c, vs, unnest(range(len(vs) + 1)) AS d FROM re)),
        node AS (SELECT node, d, CASE WHEN d > 0 THEN any_value(up) END AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                        coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d)), sha256('')) AS ends_sha256 FROM p GROUP BY node, d),
        kids AS (SELECT up AS node, count(*) AS k FROM node WHERE up IS NOT NULL GROUP BY up),
        under AS (SELECT DISTINCT a.node, b.node AS below, b.d FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d),
        sub AS (SELECT u.node, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved
                FROM under u JOIN node n ON n.node = u.below LEFT JOIN kids ON kids.node = u.below GROUP BY u.node)
        SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.k, 0) AS n_children, sub.n_leaves, sub.saved AS saved_tokens, node.ends_sha256
        FROM node JOIN sub USING (node) LEFT JOIN kids USING (node) LEFT JOIN node up ON up.node = node.up
    """,
    "op13_vector_codes": _codes_sql(),
}
