"""The thin queries of the corpus operators: whole tables, production parameters; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pledgework.llm import archives, chat, classlm, codebooks, collocations, fingerprints, jaccard, mincut, mixing, packing, secrets, toxicity, webp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(table(spark, sf_dir, "documents"))


def op4_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_columns(table(spark, sf_dir, "documents"))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", "text", "copy", "n_copies")


def op6_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_round_trip(table(spark, sf_dir, "pages"))


def op11_mincut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(table(spark, sf_dir, "pages"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def op13_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_role_repair, op2_secret_scan, op3_class_bigrams, op4_webp_media, op5_poisson_mix, op6_merkle_fingerprint, op8_toxicity_grammar, op7_best_fit_packing, op9_shingle_join, op10_arc_to_warc, op11_mincut_text, op12_delta_lloyd, op13_suffix_sigma)}
ORACLES = {
    "op5_poisson_mix": mixing.ORACLE_SQL.format(docs="documents", columns="doc_id, source, lang, n_chars, text, copy, CAST(n_copies AS BIGINT) AS n_copies"),
    "op10_arc_to_warc": archives.ORACLE_SQL.format(pages="pages"),
    "op12_delta_lloyd": codebooks.ORACLE_SQL.format(vectors="embeddings"),
    "op13_suffix_sigma": collocations.ORACLE_SQL.format(docs="documents"),
}
