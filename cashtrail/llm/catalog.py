"""The queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html, lattice, mixing, near_vectors, ngram_join, packing, resampling, runs, secrets, simhash, templates, toxicity
from .common import table

NEXT_CONVERSATION = -7      # the extra conversation whose texts are control strings
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(table(spark, sf_dir, "pages"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT {NEXT_CONVERSATION}L AS conv_id, turn, role, '{CONTROL_TEXT}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return templates.digest_chats(templates.format_chats(turns.unionByName(extra)))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").alias("source"), F.col("row.text").alias("text"),
                        F.round("rate", 9).alias("rate"), "copies", "copy", "place")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_report(table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.report(table(spark, sf_dir, "documents"))


def packing_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"))).drop("slack")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=100)


def ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


def near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.report(table(spark, sf_dir, "embeddings"))


def target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": html_extraction,
    "op2_secret_scan": secret_scan,
    "op3_chat_format": chat_format,
    "op4_source_mix": source_mix,
    "op5_simhash": fingerprints,
    "op6_toxicity": toxicity_scores,
    "op7_lattice_score": lm_scores,
    "op8_packing": packing_,
    "op9_cross_polytope": neighbours,
    "op10_ngram_join": ngram_components,
    "op11_sorted_passes": near_embeddings,
    "op12_resampling": target_resampling,
    "op13_periodic_runs": periodic_runs,
}
SQL: dict[str, str] = {"op3_chat_format": templates.SQL, "op4_source_mix": mixing.SQL, "op10_ngram_join": ngram_join.SQL,
                       "op12_resampling": resampling.SQL}
