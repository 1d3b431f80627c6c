"""The text operators as named queries over the standard tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from kinetra.llm import ball_codes, bpe, chat_format, digest, divergence, hpylm, html_extract, kmeans_tree, mixing, ppm_lang, secret_scan, simhash, wu_manber
from kinetra.llm.common import documents, small_batches

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("text_key")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.fit_and_scan(documents(spark, sf_dir))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.fit_and_score(documents(spark, sf_dir))


def op7_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_edits(documents(spark, sf_dir))


def op8_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_lang.predictions(documents(spark, sf_dir))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def _job(query: Query) -> Query:
    """The query with small Arrow batches."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: _job(f)
    for f in (
        op1_simhash_dedup,
        op2_source_mix,
        op3_secret_scan,
        op4_bpe_codec,
        op5_html_extract,
        op6_pitman_yor,
        op7_quartile_digest,
        op8_kmeans_tree,
        op9_ppm_language,
        op10_chat_format,
        op11_ball_codes,
        op12_decontaminate,
        op13_source_divergence,
    )
}

ORACLES: dict[str, str] = {
    "op2_source_mix": mixing.SQL,
    "op10_chat_format": chat_format.SQL,
    "op11_ball_codes": ball_codes.SQL,
    "op12_decontaminate": wu_manber.SQL,
    "op13_source_divergence": divergence.SQL,
}
