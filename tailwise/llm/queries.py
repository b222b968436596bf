"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwise.llm import bytebpe, idfile, languages, linededup, ngramjoin, orderminhash, packing, periodic, quality, resampling, resharding, revisits, secrets
from tailwise.llm.common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.withColumn("llr", F.round("llr", 6))


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary; the package that holds it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.code_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.compare_edited(documents(spark, sf_dir))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).drop("found")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.withColumn("headers", revisits.printed(F.col("headers")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(documents(spark, sf_dir))


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.round_trip(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op3_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From shards by source, which a hot source makes uneven, to shards of near equal bytes."""
    by_source = F.pmod(F.xxhash64("source"), F.lit(resharding.SHARDS)).cast("int")
    return resharding.reshard(documents(spark, sf_dir), by_source)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.join(documents(spark, sf_dir)).withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapse(periodic.planted(documents(spark, sf_dir))))


def op12_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = languages.predict(docs, *languages.learn(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_byte_level_bpe, op3_min_cost_flow_resharding, op4_line_dedup, op5_best_fit_packing, op6_order_minhash, op7_secret_scans, op8_warc_revisits, op9_ngram_jaccard_join, op10_token_id_files, op11_periodic_runs, op12_language_mixtures, op13_importance_resampling)}
