"""A training corpus from raw documents, in five stages that each use one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.

In every stage a null text counts as empty, rows with the same or no identifier are documents
of their own, rows alike in everything are told apart by their place only, columns beyond
those of documents stay as they are whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.bpe import encode_decode
from residua.llm.common import Scratch, column, packed, ranked
from residua.llm.line_dedup import line_dedup
from residua.llm.mixing import mixed_documents
from residua.llm.ngram_join import jaccard_components
from residua.llm.quality import fit_quality, score_quality


def _free(name: str, docs: DataFrame) -> str:
    """The name, or with underscores behind it, as no column of the documents has it."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents and the column that names each row: the identifier, or where it is null or
    repeats, a row number in the order of identifier (null last) and text."""
    unclear = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1")
    if unclear.isEmpty():
        return docs, "doc_id"
    rows = docs.select(
        packed(docs.columns).alias("row"), F.col("doc_id").isNull().alias("none"), "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.monotonically_increasing_id().alias("place"),
    )
    rows = ranked(Scratch(spark, "rows"), rows, ["none", "doc_id", "hash", "place"], "number")  # the place deals out copies
    key = _free("number", docs)
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("number").alias(key)), key


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained scorer rejects go; a text that is null, empty or
    without words has the score 0 and goes. A tie at the threshold stays. Rows that are alike
    have one score, so all of them stay or go."""
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("row"), "text")
    scored = score_quality(rows, fit_quality(spark, docs))
    return scored.filter(F.col("score") >= 0.5).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document before holds already go; the document stays with the others, as
    an empty text if none is left. Before is what has the smaller identifier, rows without one
    last; ties are broken by a hash of the text, then by place."""
    rows, key = _numbered(spark, docs)
    text = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    left = line_dedup(spark, rows, id_col=key, carry=tuple(c for c in rows.columns if c not in text))
    return left.select(*(text.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, 0.8 or more), the document
    with the smallest identifier stays, of several the one with the smallest hash of its text.
    Empty texts are near nothing and stay."""
    rows, key = _numbered(spark, docs)
    found = jaccard_components(spark, rows, id_col=key)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").select(*map(column, docs.columns))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: documents come up to twice, whole but for one a source,
    of which a pass may take the first words. A null source is a source; documents without
    words are nothing to mix and go."""
    mixed = mixed_documents(spark, docs)
    return mixed.select(*(
        F.length("text").cast("long").alias(c) if c == "n_chars" else column(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to the very text. An empty text has no
    ids. Repeated rows give repeated results."""
    import public_tokenizers

    out = encode_decode(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), carry=("source", "text"))
    return out.select(
        "doc_id", "carried.source", "n_tokens", "ids",
        (F.col("decoded") == F.coalesce("carried.text", F.lit(""))).alias("lossless"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_to_weights),
    ("BPE encoding and decoding", encode),
]
#: SQL cannot train the classifier nor merge byte pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
