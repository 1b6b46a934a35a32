"""The queries `opN_<name>`: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinata.llm import bpe, fingerprint, jaccard, kdtree, langid, mixing, nearvec, oracles, quality, toxicity, urlfilter
from ordinata.llm.common import prepare, table


#: The rules of op8: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out).select(F.col("doc_id").alias("id"), "text", "lang"))
    return langid.predict(docs, model, keep=(held_out.alias("held_out"),)).withColumnRenamed("id", "doc_id")


def token_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, then decoded from the ids."""
    prepare(docs.sparkSession)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decode = bpe.decoder(docs.sparkSession, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in decode(batches):
            ids, text = b.column("ids").to_pylist(), b.column("decoded").to_pylist()
            sha = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bpe.encode(docs, path, public_tokenizers.PATTERN, then=digest, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op3_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = kdtree.shard(table(spark, sf_dir, "documents"), shards=8)
    return d.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = jaccard.link(table(spark, sf_dir, "documents"), percent=80, k=5)
    return d.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select(F.col("id").alias("doc_id"), F.col("content").alias("content_score"), F.col("page").alias("page_score"), "score", "keep")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.withColumnRenamed("id", "doc_id")


#: Shares of the tokens that op7 aims at: clean, low quality, toxic.
MIX = [0.94, 0.05, 0.01]


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    d = mixing.mix(docs, mixing.domains(table(spark, sf_dir, "labels")), MIX)
    of = lambda c: [F.col(c)[i].alias(f"{c}_{n}") for i, n in enumerate(("clean", "low", "toxic"))]
    return d.select(F.col("id").alias("doc_id"), "tokens", *of("p"), "rate", "copies", *of("reached"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = nearvec.links(table(spark, sf_dir, "embeddings"), cosine=0.93)
    return d.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return d.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint.written(F.col("keys")).alias("fingerprint"), fingerprint.written(F.col("edited_keys")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def next_and_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10 that SQL can express: the next document and the edited text."""
    d = fingerprint.edits(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_byte_level_bpe": op2_byte_level_bpe,
        "op3_kd_tree_sharding": op3_kd_tree_sharding,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_toxicity": op6_toxicity,
        "op7_mixing_sources": op7_mixing_sources,
        "op8_url_filters": op8_url_filters,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_document_fingerprints": op10_document_fingerprints,
        "next_and_edited": next_and_edited,
    }


def oracle_sql() -> dict[str, str]:
    """The others are learned, or rest on files and hashes that SQL has not."""
    return {"op4_ngram_jaccard_join": oracles.JACCARD, "op8_url_filters": oracles.urls(URL_RULES), "op9_embedding_near_dedup": oracles.NEAR, "next_and_edited": oracles.EDITED}
