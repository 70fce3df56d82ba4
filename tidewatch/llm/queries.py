"""Registered queries of the operators: whole tables, production parameters, the columns their contracts name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, chat, html_text, imatch, lines, mixing, packing, periodic, repetition, search, secrets, simhash, suffix
from tidewatch.llm.common import table


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(table(spark, folder, "documents")))


def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"), shingle=3, budget=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.chat_digest(chat.with_probe(table(spark, folder, "conversations")))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    measured = repetition.repetition(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return measured.withColumns({"base_failed": repetition.base_failed(), "kept": repetition.passes()})


def op7_imatch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprint_edits(table(spark, folder, "documents"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("long").alias("n_kept_bytes"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", F.length("text").cast("long").alias("n_kept_chars"))


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op11_bpe_round_trip(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    lexicon = bpe.build_lexicon(documents, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    decoded = bpe.decode(bpe.encode(documents, lexicon), lexicon)
    return decoded.select("doc.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return periodic.run_digest(periodic.periodic_runs(documents, F.crc32(F.col("doc_id").cast("string").cast("binary"))))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return search.search(search.build_index(documents), documents, table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_html_extraction": op4_html_extraction,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_quality_rules": op6_quality_rules,
    "op7_imatch_fingerprints": op7_imatch_fingerprints,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ranked_search": op13_ranked_search,
}
