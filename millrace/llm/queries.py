"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import embedding_dedup, jaccard_join, language_id, line_crf, line_dedup, merkle_manifest, packing, periodic_runs, quality_rules, repair_output, secret_scan, source_mix, url_filter
from millrace.llm.common import settled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@settled
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(_table(spark, sf_dir, "pages"))


@settled
def op2_repair_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_output.digests(repair_output.write_shards(_table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measured(_table(spark, sf_dir, "documents"))


@settled
def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@settled
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken_words(_table(spark, sf_dir, "documents"))


@settled
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


@settled
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


@settled
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


@settled
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


@settled
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(_table(spark, sf_dir, "documents"))


@settled
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_table(spark, sf_dir, "documents"))


@settled
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_repair_output, op3_quality_rules, op4_line_crf, op5_source_mix, op6_secret_scan, op7_packing, op8_line_dedup, op9_jaccard_join, op10_embedding_dedup, op11_periodic_runs, op12_language_id, op13_merkle_manifest)}

ORACLE_SQL = {"op1_url_filter": url_filter.ORACLE_SQL, "op3_quality_rules": quality_rules.ORACLE_SQL, "op6_secret_scan": secret_scan.ORACLE_SQL, "op8_line_dedup": line_dedup.DIGESTS_SQL, "op13_merkle_manifest": merkle_manifest.ORACLE_SQL}
