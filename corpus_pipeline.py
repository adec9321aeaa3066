"""The corpus pipeline: stages over whole documents, each stage's rows written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import credentials, jaccard, language, packing
from strandline.llm.common import shared_folder
from strandline.plans.sizing import lookup_side

TOKENIZER = "byte_bpe_50k.json"
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
SEQUENCE_IDS = 2048
BATCH_SETTING, BATCH_TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def _small_batches(spark: SparkSession) -> None:
    """Fewer texts in an Arrow batch than Spark's 10,000, of which JVM and Python each hold copies.

    A stage's result is computed after the stage returns, so the setting stays; ``run`` puts the old one back.
    """
    spark.conf.set(BATCH_SETTING, BATCH_TEXTS)


def _aside(docs: DataFrame, names: list[str]) -> DataFrame:
    """Keep the documents' own columns of ``names`` under other names while an operator adds its."""
    return docs.withColumnsRenamed({n: f"__own_{n}" for n in names if n in docs.columns})


def _back(changed: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``docs``, in their order and under their names."""
    return changed.select([F.col(f"__own_{c}").alias(c) if c in names else F.col(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: null texts and texts without a letter.

    The model learns from the documents' own languages. Where none is known, no text with letters is dropped.
    """
    _small_batches(spark)
    added = ["lang_pred", "score", "spans"]
    model = language.fit(language.training_rows(docs))
    found = language.predict(_aside(docs, added), model)
    known = F.col("lang_pred") != language.UNKNOWN
    kept = found.where(known if model.langs else F.col("text").rlike(r"\p{L}"))
    return _back(kept, docs, added)


def _row_keys(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents with a ``__key`` for each pair of id and text, in the order of the ids; null without id.

    Where no id has several texts, which is the rule, it is the id itself. Otherwise the different pairs of id and text hash are
    numbered in ranges of the ids.
    """
    pairs = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("__hash"))
    mixed = pairs.groupBy("doc_id").agg(F.min("__hash").alias("a"), F.max("__hash").alias("b")).where("a <> b")
    if mixed.isEmpty():
        return docs.withColumn("__key", F.col("doc_id"))
    numbered = lookup_side(pairs.distinct().repartitionByRange("doc_id", "__hash").sortWithinPartitions(
        "doc_id", "__hash").withColumn("__key", F.monotonically_increasing_id()))
    return docs.withColumn("__hash", F.xxhash64("text")).join(numbered, ["doc_id", "__hash"], "left").drop("__hash")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near copies the document with the smallest id, and one row of it.

    Rows of one id with different texts are judged apart, and only rows that repeat id and text count as one.
    Documents without id and documents without words are kept.
    """
    _small_batches(spark)
    keyed = _row_keys(spark, docs)
    groups = jaccard.near_groups(keyed, SHINGLE_WORDS, SIMILAR_PERCENT, "__key")
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__key")).distinct()
    kept = keyed.join(lookup_side(others), "__key", "left_anti")
    repeated = lookup_side(kept.where("__key is not null").groupBy("__key").agg(
        F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select("__key"))
    return kept.join(repeated, "__key", "left_anti").unionByName(
        kept.join(repeated, "__key", "left_semi").dropDuplicates(["__key"])).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret; other texts stay as they are. ``n_chars`` follows the text."""
    _small_batches(spark)
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    masked = credentials.redact(credentials.scan(_aside(docs, added)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("spans") != "", F.length("text")).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _back(masked, docs, added)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' ids into training sequences."""
    _small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), SEQUENCE_IDS)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

# The guess counts and the packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = shared_folder(spark, "pipeline"), spark.conf.get(BATCH_SETTING)
    try:
        for number, (_, stage) in enumerate(STAGES):
            target = f"{folder}/{number}"
            stage(spark, docs, sf_dir).write.parquet(target)
            docs = spark.read.parquet(target)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
