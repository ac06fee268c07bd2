"""Queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.llm import classifier, decontaminate, licenses, negatives, packing, pii, resample, rules, secrets, sharding, simhash, tokencount, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.flag_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.digest(F.col("items")).alias("items_sha256"), "contaminated")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.KINDS)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_duplicates(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has no paths: a source is a tree, with a directory for each language and, in it, for each
    # hundred ids; every third document lies in each of the three depths
    depth = F.pmod(F.col("doc_id"), F.lit(3))
    folder = F.when(depth > 0, F.col("lang")), F.when(depth > 1, F.expr("cast(doc_id div 100 as string)"))
    path = F.concat_ws("/", "source", *folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), path=path, notice_speaks=True)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_simhash": op6_simhash,
    "op7_personal_data": op7_personal_data,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc_archive": op9_warc_archive,
    "op10_license_scan": op10_license_scan,
    "op11_sharding": op11_sharding,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL = {
    "op1_quality_rules": rules.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op9_warc_archive": warc.SQL,
    "op11_sharding": sharding.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_importance_resampling": resample.SQL,
}
