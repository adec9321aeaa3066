"""One query per corpus operator over the whole test tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import (
    conversations, covertree, credentials, decontamination, jaccard, kdtree, language, manifest, packing,
    pfor, pieces, url_reputation, warc)
from strandline.llm.oracle import ORACLE  # noqa: F401

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    return warc.archive_pages(_table(spark, sf_dir, "pages")).drop("uri")


def op2_secrets(spark, sf_dir):
    return credentials.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_token_blocks(spark, sf_dir):
    return pfor.store_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_cover_tree(spark, sf_dir):
    return covertree.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(language.training_rows(docs))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_jaccard_join(spark, sf_dir):
    return jaccard.near_groups(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_kdtree_topk(spark, sf_dir):
    return kdtree.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_url_reputation(spark, sf_dir):
    """Verdict on every page; a labelled document of the same id gives a page's outcome."""
    labels = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_reputation.judge_urls(_table(spark, sf_dir, "pages"), labels, RULES)


def op11_conversation_repair(spark, sf_dir):
    """Conversations with known damage, and the cheapest way to put each right."""
    return conversations.conversation_report(conversations.damaged(_table(spark, sf_dir, "conversations")), F.col("lost"))


def op12_decontamination(spark, sf_dir):
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark, sf_dir):
    """Every document proven against the manifest, those with an even crc32 of their id after their line ends are gone."""
    docs = _table(spark, sf_dir, "documents")
    bare = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    changed = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    return manifest.audit(docs, ["doc_id", "source", "lang", "n_chars", "text"], {"text": bare}, changed)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_secrets": op2_secrets,
    "op3_token_blocks": op3_token_blocks,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_cover_tree": op5_cover_tree,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_kdtree_topk": op9_kdtree_topk,
    "op10_url_reputation": op10_url_reputation,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_decontamination": op12_decontamination,
    "op13_merkle_manifest": op13_merkle_manifest,
}
