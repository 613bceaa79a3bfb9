"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.llm import decontam, licences, media, mixing, ngramjoin, ordinal, pii, staging, substrings, tokenstore, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_private(table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.shared_folder(spark)
    tokenstore.write(table(spark, sf_dir, "documents"), path, tokenizer_file())
    tokenstore.verify(spark, path)
    return tokenstore.starts(tokenstore.digests(spark, path)).select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit(docs, ordinal.ratings_of(table(spark, sf_dir, "labels")), grades=3)
    rows = docs.select("doc_id", ordinal.graded(docs, model).alias("g"))
    return rows.select("doc_id", F.col("g.expected").alias("expected_grade"), F.col("g.tail").alias("p_tail"), (F.col("g.tail") >= ordinal.SELECT).alias("selected"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_groups(table(spark, sf_dir, "documents"), words=3, num=90, den=100).withColumnRenamed("component", "component_id")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_private_data, op2_decontamination, op3_substring_dedup, op4_token_store, op5_mixing, op6_url_filter, op7_quality, op8_ngram_join, op9_licences, op10_media)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontam.ORACLE, "op3_substring_dedup": substrings.ORACLE, "op6_url_filter": urls.ORACLE, "op8_ngram_join": ngramjoin.ORACLE, "op9_licences": licences.ORACLE}
