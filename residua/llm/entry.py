"""The queries of this subpackage. Each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import shipped


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(spark, f"{sf_dir}/documents.parquet").drop("file", "row")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify_quality

    return classify_quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(spark, docs, width=4, similarity=(85, 100))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_decode(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleaved_shards

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return interleaved_shards(spark, docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_embeddings

    return near_embeddings(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(spark, docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data, span_text

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = find_personal_data(spark, docs)
    spans = spans.withColumn("base", F.filter("spans", lambda x: x["base"]))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return spans.select(
        "doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_quality, op3_jaccard_join, op4_bpe, op5_interleaved_shards, op6_mix_sources, op7_near_embeddings, op8_licenses, op9_line_dedup, op10_personal_data, pipeline,
)}


def queries():
    return {name: shipped(query) for name, query in QUERIES.items()}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, {_LOWER.format(_STRIP.format("line"))} AS key FROM l),
h AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, coalesce(h.holder <> k.doc_id, false) AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def oracle_sql():
    return {"op1_exact_dedup": OP1_SQL, "op9_line_dedup": OP9_SQL}
