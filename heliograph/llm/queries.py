"""The thin queries ``opN_<name>``: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, jaccard, language, licenses, media, packing, pii, quality, secrets, tokens, vafile, warc
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(n(k).alias(f"n_{k}") for k in pii.BASE_KINDS), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.concat_ws(",", c).alias(c) for c in ("sentence_ids", "licenses", "remaining")))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.select("record_id", "type", "refers_to", "target_uri", "content_type", F.octet_length("block").cast("long").alias("content_length"), "block_digest", "source_block_digest", "source_payload_digest")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.media_columns(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = tokens.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_groups(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    model = language.fit(docs.where(~held_out).select("text", "lang"))
    return language.predict(docs, model, "text", F.col("doc_id"), held_out)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.with_inertia(vafile.cluster(table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_license_scan, op3_warc_derivatives, op4_token_counts, op5_media_columns, op6_packing, op7_bpe_codec, op8_quality_rules, op9_jaccard_groups, op10_personal_data, op11_collocations, op12_language_id, op13_centroid_clusters)}

ORACLES = {"op2_license_scan": licenses.oracle_sql(), "op3_warc_derivatives": warc.oracle_sql(), "op8_quality_rules": quality.oracle_sql(), "op9_jaccard_groups": jaccard.oracle_sql(), "op11_collocations": collocations.oracle_sql(), "op13_centroid_clusters": vafile.oracle_sql()}
